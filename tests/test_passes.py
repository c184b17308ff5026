"""Merged moments, global numbers, starting rows and the run axis of the iterative models."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_models import model, sequences, vectors
from tidepanel.operators import features as J
from tidepanel.operators import hmm as H
from tidepanel.operators import importance as I
from tidepanel.operators import mixture as M
from tidepanel.operators import moments as N
from tidepanel.operators.passes import Span, numbered, starting_rows


# ---- moments ----------------------------------------------------------------------------------------

@pytest.mark.parametrize("shift", [0.0, 1e8])
def test_moments_of_values_far_from_zero(spark, shift):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 5)) @ rng.normal(size=(5, 5)) + shift
    x[:, 4] = 0.1  # constant
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 0] = rng.normal(size=900) + shift
    rows = [([None if np.isnan(v) else float(v) for v in row],) for row in x]
    got = {(r["i"], r["j"]): r for r in N.correlation_pairs(spark.createDataFrame(rows, "x array<double>").repartition(7), "x").collect()}
    frame = pd.DataFrame(x - shift)
    for i in range(5):
        for j in range(i, 5):
            both = frame[[i, j]].dropna()
            assert got[i, j]["n"] == len(both)
            assert got[i, j]["cov"] == pytest.approx(np.cov(both.to_numpy().T)[0, 1] if i != j else frame[i].var(), rel=1e-6, abs=1e-6)
            if 4 in (i, j):
                assert got[i, j]["corr"] is None
            else:
                assert got[i, j]["corr"] == pytest.approx(frame[i].corr(frame[j]), abs=1e-7)


def test_merging_does_not_depend_on_the_order():
    rng = np.random.default_rng(1)
    x = rng.normal(1e7, 1, size=(400, 3))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:20, 1] = np.nan  # a batch without a column
    parts = [N.pair_summary(p) for p in np.split(x, [20, 21, 150])]
    left = N.merged_pairs(N.merged_pairs(N.merged_pairs(parts[0], parts[1]), parts[2]), parts[3])
    right = N.merged_pairs(parts[3], N.merged_pairs(parts[2], N.merged_pairs(parts[1], parts[0])))
    assert np.allclose(left, right, rtol=1e-9) and np.allclose(left, N.pair_summary(x), rtol=1e-9)
    y = rng.normal(1e9, 1, size=(300, 2))
    n, mean, var = N.column_stats(N.merged_columns(N.column_summary(y[:7]), N.merged_columns(N.column_summary(y[:0]), N.column_summary(y[7:]))))
    assert n == 300 and np.allclose(mean, y.mean(0), rtol=1e-15) and np.allclose(var, y.var(0), rtol=1e-6)


def test_wide_vectors_travel_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 10)
    x = np.random.default_rng(2).normal(5, 2, size=(200, 12))
    mean, cov, n = N.covariance_matrix(vectors(spark, x), "x")
    assert n == 200 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    pairs = {(r["i"], r["j"]): r["cov"] for r in N.correlation_pairs(vectors(spark, x), "x").collect()}
    assert len(pairs) == 78 and pairs[3, 9] == pytest.approx(np.cov(x.T)[3, 9])


def test_components_of_several_tables_in_one_pass(spark):
    rng = np.random.default_rng(3)
    tables = {"a": rng.normal(size=(80, 3)) + 1e6, "b": rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))}
    df = spark.createDataFrame([(name, i, row.tolist()) for name, x in tables.items() for i, row in enumerate(x)], "config string, i int, x array<double>").repartition(4)
    models = J.fit_components_by(df, "x", "config")
    scored = J.component_scores(df, "x", models, "config").toPandas()
    for name, x in tables.items():
        one = J.fit_components(df.where(F.col("config") == name), "x")
        assert np.allclose(one.loadings, models[name].loadings) and np.allclose(one.ratio, models[name].ratio)
        got = np.stack(scored[scored["config"] == name].sort_values("i")["scores"])
        assert np.allclose(got, (x - x.mean(0)) / x.std(0) @ one.loadings.T, atol=1e-6)
        spread = np.cov(got.T, ddof=0)
        assert np.allclose(spread, np.diag(np.diag(spread)), atol=1e-8) and np.allclose(np.diag(spread) / x.shape[1], one.ratio)


# ---- numbers and starting rows --------------------------------------------------------------------------

def test_numbers_are_a_permutation_in_order(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 50, 3000).tolist()
    rows = numbered(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v long").repartition(5), "v", "i").toPandas().sort_values("idx")
    assert rows["idx"].tolist() == list(range(3000)) and list(zip(rows["v"], rows["i"])) == sorted(zip(values, range(3000)))
    assert numbered(spark.createDataFrame([], "v long"), "v").count() == 0


def test_few_different_rows_send_few_rows(spark):
    """Three different vectors in many rows: three starting rows, and at most k rows per run and task travel."""
    x = np.repeat(np.array([[0.0, 1.0], [5.0, 5.0], [-0.0, 1.0 + 2**-40]]), 30_000, axis=0)
    df = vectors(spark, x)
    found = starting_rows(df, {"a": (Span(), 3, 0), "b": (Span(hi=60_000), 2, 1)})
    assert sorted(map(tuple, found["a"])) == [(0.0, 1.0), (0.0, 1.0 + 2**-40), (5.0, 5.0)] and len(found["b"]) == 2
    with pytest.raises(ValueError, match="fewer than 4"):
        starting_rows(df, {"a": (Span(), 4, 0)})


def test_an_open_span_keeps_every_number(spark):
    ends = np.array([-(2**63), -(2**62) - 1, 0, 2**62 + 1, 2**63 - 1])
    assert Span().mask(ends).all() and Span(0, 5).mask(ends).tolist() == [False, False, True, False, False]
    rows = spark.range(500).select(F.xxhash64("id").alias("idx"), F.array(F.col("id").cast("double")).alias("x"))
    fit = M.fit(rows, M.restarts("m", 1, 1))["m"]
    assert fit.n == 500 and M.score(rows, [fit]).count() == 500


def test_partners_are_a_permutation_of_the_whole_table(spark):
    x = np.arange(2000.0)[:, None] * [1.0, -1.0]
    df = spark.createDataFrame([(row.tolist(), float(i % 2)) for i, row in enumerate(x)], "x array<double>, label double").repartition(6)
    rows = I.partnered(df, "x", "label", seed=3, repeats=2).toPandas()
    own, partners = np.stack(rows["x"]), np.stack([np.stack(p) for p in rows["partners"]])
    for r in range(2):
        assert sorted(partners[:, r, 0]) == sorted(x[:, 0])
        assert abs(np.corrcoef(own[:, 0], partners[:, r, 0])[0, 1]) < 0.1
    assert (partners[:, 0, 0] != partners[:, 1, 0]).mean() > 0.9
    again = I.partnered(df.repartition(3), "x", "label", seed=3, repeats=2).toPandas()
    key = lambda f: sorted((tuple(a), *map(tuple, p)) for a, p in zip(f["x"], f["partners"]))
    assert key(again) == key(rows)


# ---- runs of hidden Markov models ---------------------------------------------------------------------------

def switching(spark, configs, n=60, seed=6):
    rng, rows = np.random.default_rng(seed), []
    for config, d in configs.items():
        for s in range(4):
            state = 0
            for i in range(n):
                state = state if rng.random() < 0.9 else 1 - state
                rows.append((config, s, dt.date(2024, 1, 1) + dt.timedelta(days=i), rng.normal(6 * state, 1, d).tolist()))
    return spark.createDataFrame(rows, "config string, seq long, date date, x array<double>")


def test_runs_together_equal_runs_alone(spark):
    df = switching(spark, {"one": 1, "two": 3})
    blocks = H.to_blocks(df, "seq", "date", "x", 16, config="config").persist()
    rows = df.select("config", F.xxhash64("seq", "date").alias("idx"), "x")
    runs = [r for c in ("one", "two") for s in range(2) for r in H.restarts(f"{c}|{s}", 2 + s, 2, s, c)]
    together = H.fit(blocks, rows, runs, max_iter=6)
    assert set(together) == {"one|0", "one|1", "two|0", "two|1"}
    for name in ("one|1", "two|0"):
        config = name[:3]
        own = blocks.where(F.col("config") == config)
        alone = H.fit(own, rows.where(F.col("config") == config), [r for r in runs if r.model == name], max_iter=6)[name]
        assert alone.loglik == pytest.approx(together[name].loglik) and np.allclose(alone.means, together[name].means)
        both = H.decode(blocks, together).where(F.col("model") == name).drop("model").toPandas()
        single = H.decode(own, alone).toPandas()
        assert both.sort_values(["seq", "date"])["state"].tolist() == single.sort_values(["seq", "date"])["state"].tolist()


@pytest.mark.parametrize("fan, levels", [(8, 2), (20, 1)])
def test_chain_in_levels_equals_one_level(spark, monkeypatch, fan, levels):
    """Blocks of one day, so that a sequence has 150 blocks and the tree several levels."""
    m = model()
    other = H.HiddenMarkov(m.means[:2], m.log_vars[:2], np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.4, 0.6]))
    _, df = sequences(spark, [150, 31, 1])
    blocks = H.to_blocks(df, "seq", "date", "x", 1).persist()
    models = {"three": m, "two": other}
    flat = [H.decode(blocks, models).toPandas(), H.filtered(blocks, models).toPandas(), H._expected(blocks, models, H.layout(blocks))]
    monkeypatch.setattr(H, "FAN", fan)
    assert H.layout(blocks).levels >= levels
    deep = [H.decode(blocks, models).toPandas(), H.filtered(blocks, models).toPandas(), H._expected(blocks, models, H.layout(blocks))]
    order = ["model", "seq", "date"]
    assert flat[0].sort_values(order)["state"].tolist() == deep[0].sort_values(order)["state"].tolist()
    assert all(np.allclose(a, b) for a, b in zip(flat[1].sort_values(order)["p"], deep[1].sort_values(order)["p"]))
    assert all(np.allclose(flat[2][name], deep[2][name]) for name in models)


def test_sequences_of_one_block_are_not_shuffled(spark):
    """They are read where they are stored, beside longer ones that are chained; both give the counts of single days."""
    m = model()
    _, df = sequences(spark, [150, 31, 1])
    short = H.stored(H.to_blocks(df.where("seq > 0"), "seq", "date", "x", 366))
    plan = H.layout(short)
    assert plan.alone and not plan.chained
    for out in (H.filtered(short, m), H.decode(short, m)):
        after = out._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0]
        assert "Join" not in after and "Aggregate" not in after
    mixed, days = H.to_blocks(df, "seq", "date", "x", 60), H.to_blocks(df, "seq", "date", "x", 1)
    assert H.layout(mixed) == H.Layout(0, H.layout(mixed).tasks, True, True)
    assert np.allclose(H._expected(mixed, {"m": m}, H.layout(mixed))["m"], H._expected(days, {"m": m}, H.layout(days))["m"])


def test_scaled_counts_equal_those_of_logarithms():
    """States before blocks, with borders on both sides; what would underflow is left to logarithms."""
    m, rng = model(), np.random.default_rng(8)
    x, lengths, first = rng.normal(0, 3, (5, 9, 1)), np.array([9, 1, 4, 9, 2]), np.array([True, False, True, False, False])
    enter, leave = rng.normal(0, 5, (5, 3)), rng.normal(0, 5, (5, 3))
    assert np.allclose(H._scaled_counts(m, x, lengths, enter, leave, first)[1], H._counts(m, x, lengths, first, enter, leave))
    sure = H.HiddenMarkov(np.array([[0.0], [1.0]]), np.log(np.full((2, 1), 1e-4)), np.eye(2), np.array([0.5, 0.5]))
    there = np.array([[[0.0], [1.0], [0.0], [1.0]]])
    assert H._scaled_counts(sure, there, np.array([4])) is None
    found = H._of_block(sure, there, np.array([4]), np.array([True]), np.array([[0.0, -np.inf]]), np.zeros((1, 2)), None)
    assert np.isfinite(found).all() and found[1] == 4 and found[5 + 4 :][:2].sum() == pytest.approx(4)


def test_models_of_values_far_from_zero(spark):
    """Shifted by 1e8 the same fits come out, shifted."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal([0, 0], [0.5, 1], (150, 2)), rng.normal([6, 5], 1, (100, 2))])
    x = np.round(x * 64) / 64  # the same numbers near 1e8
    fits = [M.fit(vectors(spark, x + shift), M.restarts("m", 2, 2), standardise=standardise)["m"] for shift, standardise in ((0, True), (1e8, True), (0, False), (1e8, False))]
    assert np.allclose(np.sort(fits[0].weights), np.sort(fits[1].weights), atol=1e-4)
    assert np.allclose(sorted(np.linalg.det(c) for c in fits[2].covs), sorted(np.linalg.det(c) for c in fits[3].covs), rtol=1e-3)
    df = switching(spark, {"": 1})
    chains = []
    for shift in (0.0, 1e8):
        moved = df.withColumn("x", F.transform("x", lambda v: F.round(v * 64) / 64 + shift))
        chains.append(H.fit(H.to_blocks(moved, "seq", "date", "x", 16), H.numbered_rows(moved, ["seq", "date"]), H.restarts("m", 2))["m"])
    a, b = chains
    order = [np.argsort(c.means[:, 0]) for c in chains]
    assert np.allclose(a.means[order[0]], b.means[order[1]] - 1e8, atol=1e-5) and np.allclose(a.log_vars[order[0]], b.log_vars[order[1]], atol=1e-4)


# ---- k-means ----------------------------------------------------------------------------------------------

def test_kmeans_of_many_runs_is_as_good_as_the_librarys(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from tidepanel.operators.passes import kmeans

    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.4, (n, 3)) for c, n in zip(rng.normal(0, 6, (8, 3)), (400, 300, 200, 100, 50, 40, 20, 10))])
    df = vectors(spark, x)
    fits = kmeans(df, {f"{k}|{s}": (Span(), k, s) for k in (2, 5, 8) for s in range(5)})
    for k in (2, 5, 8):
        theirs = min(KMeans(k=k, seed=s, maxIter=50, featuresCol="v").fit(df.select(array_to_vector("x").alias("v"))).summary.trainingCost for s in range(3))
        costs = [fits[f"{k}|{s}"][1] for s in range(5)]
        assert min(costs) <= theirs * 1.001
        centres, cost = fits[f"{k}|0"]
        assert cost == pytest.approx(((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum())
    with pytest.raises(ValueError, match="distinct"):
        kmeans(vectors(spark, np.zeros((50, 2))), {"a": (Span(), 2, 0)})
