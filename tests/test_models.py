"""Iterative models and optimisation against brute force."""

from __future__ import annotations

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import clusters as C
from tidepanel.operators import evaluate as V
from tidepanel.operators import factors as X
from tidepanel.operators import features as J
from tidepanel.operators import hmm as H
from tidepanel.operators import mixture as M
from tidepanel.operators import optimise as Z
from tidepanel.operators import risk as R
from tidepanel.operators.passes import Span


def vectors(spark, x):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "idx long, x array<double>").repartition(3)


# ---- residuals ------------------------------------------------------------------------------------

@pytest.mark.parametrize("halflife", [3, 60])
def test_residual_equals_a_regression_per_row(spark, halflife):
    """With a half-life of 3 a block is 192 rows, so the series spans several blocks."""
    rng = np.random.default_rng(0)
    n, k, burn = 600, 2, 20
    x = rng.normal(size=(n, k))
    y = x @ [0.5, -1.0] + 0.2 + rng.normal(size=n)
    rows = [("a", (dt.date(2020, 1, 1) + dt.timedelta(days=i)), float(y[i]) if i != 50 else None, x[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "factor string, date date, y double, x array<double>")
    got = X.ew_residual(df, ["factor"], k, halflife=halflife, min_periods=burn).orderBy("date").toPandas()["resid"].to_numpy(float)
    keep = np.arange(n) != 50
    xs, ys = np.column_stack([np.ones(n), x])[keep], y[keep]
    lam, expected = 0.5 ** (1 / halflife), np.full(n - 1, np.nan)
    for t in range(burn, n - 1):
        w = lam ** (t - 1 - np.arange(t))
        a = (xs[:t] * w[:, None]).T @ xs[:t] + 1e-8 * lam**t * np.eye(k + 1)
        expected[t] = ys[t] - xs[t] @ np.linalg.solve(a, (xs[:t] * w[:, None]).T @ ys[:t])
    assert np.allclose(got, expected, atol=1e-9, equal_nan=True)


# ---- components -----------------------------------------------------------------------------------

def test_components_match_a_direct_decomposition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6)
    df = vectors(spark, x)
    model = J.fit_components(df, "x", 0.95)
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    ratio = s**2 / (s**2).sum()
    keep = int((np.cumsum(ratio) < 0.95).sum()) + 1
    assert len(model.ratio) == keep and np.allclose(model.ratio, ratio[:keep])
    assert np.allclose(np.abs(model.loadings), np.abs(vt[:keep]), atol=1e-8)
    scores = np.stack(model.scores(df, "x").orderBy("idx").toPandas()["scores"])
    assert np.allclose(scores, z @ model.loadings.T)


# ---- mixtures --------------------------------------------------------------------------------------

@pytest.mark.parametrize("covariance", ["full", "diag"])
def test_mixture_separates_clusters_and_never_loses_likelihood(spark, covariance):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal([0, 0], 0.5, (150, 2)), rng.normal([5, 5], 1.0, (100, 2)), rng.normal([-5, 5], 0.7, (50, 2))])
    df = vectors(spark, x)
    m = M.fit(df, M.restarts("m", 3, 3), covariance=covariance)["m"]
    assert m.converged and all(b >= a - 1e-6 for a, b in zip(m.history, m.history[1:]))
    labels = M.score(df, [m]).orderBy("idx").toPandas()
    assert np.allclose(np.stack(labels["p"]).sum(axis=1), 1)
    sizes = sorted(labels["label"].value_counts().tolist())
    assert np.allclose(sizes, [50, 100, 150], atol=4)
    assert labels["logp"].sum() == pytest.approx(m.loglik, rel=1e-6)


def test_spans_restrict_a_run(spark):
    x = np.vstack([np.random.default_rng(3).normal(0, 1, (100, 2)), np.random.default_rng(4).normal(50, 1, (100, 2))])
    runs = [M.Run("first", 1, 0, Span(0, 100)), M.Run("cut", 1, 0, Span(0, 200, 0, 100))]
    fits = M.fit(vectors(spark, x), runs)
    assert fits["first"].n == fits["cut"].n == 100
    assert np.allclose(fits["first"].mean, x[:100].mean(0)) and np.allclose(fits["cut"].mean, x[100:].mean(0))


# ---- hidden Markov ------------------------------------------------------------------------------------

def model():
    return H.HiddenMarkov(np.array([[0.0], [2.0], [-1.5]]), np.log(np.array([[1.0], [0.5], [2.0]])),
                          np.array([[0.8, 0.1, 0.1], [0.3, 0.6, 0.1], [0.2, 0.3, 0.5]]), np.array([0.5, 0.2, 0.3]))


def sequences(spark, lengths, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=i), [float(rng.normal(0, 2))]) for s, n in enumerate(lengths) for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq long, date date, x array<double>")


@pytest.mark.parametrize("width", [1, 2, 64])
def test_decoded_path_is_the_best_of_all_paths(spark, width):
    m = model()
    rows, df = sequences(spark, [6, 5, 1])
    path = H.decode(H.to_blocks(df, "seq", "date", "x", width), m).toPandas()
    la, lp = np.log(m.transition), np.log(m.start)
    for s in range(3):
        lb = m.emissions(np.array([r[2] for r in rows if r[0] == s]))
        best = max(itertools.product(range(3), repeat=len(lb)),
                   key=lambda p: lp[p[0]] + lb[0, p[0]] + sum(la[a, b] + lb[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:]))))
        assert tuple(path[path["seq"] == s].sort_values("date")["state"]) == best


@pytest.mark.parametrize("width", [1, 7, 64])
def test_filtered_probabilities_equal_the_plain_recursion(spark, width):
    m = model()
    rows, df = sequences(spark, [40, 9])
    got = H.filtered(H.to_blocks(df, "seq", "date", "x", width), m).toPandas()
    for s in range(2):
        b = np.exp(m.emissions(np.array([r[2] for r in rows if r[0] == s])))
        a, expected = m.start * b[0], []
        for t in range(len(b)):
            a = a / a.sum() if t == 0 else (a @ m.transition) * b[t] / ((a @ m.transition) * b[t]).sum()
            expected.append(a)
        assert np.allclose(np.stack(got[got["seq"] == s].sort_values("date")["p"]), expected)


def test_expected_counts_do_not_depend_on_the_block_width(spark):
    m = model()
    _, df = sequences(spark, [70, 33, 1])
    results = []
    for width in (1, 10, 100):
        blocks = H.to_blocks(df, "seq", "date", "x", width)
        results.append(H._expected(blocks, {"m": m}, H.layout(blocks))["m"])
    assert np.allclose(results[0], results[1]) and np.allclose(results[0], results[2])
    assert results[0][2] == 3 and results[0][6:15].sum() == pytest.approx(104 - 3)


def test_fit_recovers_sticky_states(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(6):
        state = 0
        for i in range(80):
            state = state if rng.random() < 0.9 else 1 - state
            rows.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=i), [float(rng.normal(6 * state, 1))]))
    df = spark.createDataFrame(rows, "seq long, date date, x array<double>")
    blocks = H.to_blocks(df, "seq", "date", "x", 32).persist()
    m = H.fit(blocks, H.numbered_rows(df, ["seq", "date"]), H.restarts("m", 2))["m"]
    assert np.allclose(m.transition.sum(axis=1), 1) and np.allclose(np.sort(m.means[:, 0]), [0, 6], atol=0.4)
    assert np.all(np.diag(m.transition) > 0.8)


# ---- clusters and quality --------------------------------------------------------------------------------

@pytest.mark.parametrize("method", ["quantile", "kmeans"])
def test_layer_probabilities_add_up_and_outliers_are_zero(spark, method):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(0, 1, (180, 4)), rng.normal(12, 1, (20, 4))])
    df = vectors(spark, x)
    out = C.with_layers(df, "x", C.fit_layers(df, "x", r=3, method=method)).orderBy("idx").toPandas()
    assert np.allclose(np.stack(out["p"]).sum(axis=1), 1)
    assert (out["label"][180:] == 0).all() and set(out["label"][:180]) - {0} <= {1, 2, 3}


def test_crisis_state_owns_the_extreme_rows(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 1, (170, 3)), rng.normal(0, 6, (30, 3))])
    df = vectors(spark, x).withColumn("label", (F.col("idx") >= 170).cast("long"))
    assert C.crisis_state(df, "x", "label") == 1


@pytest.mark.parametrize("n_blocks", [1, 4])
def test_silhouette_equals_the_pairwise_definition(spark, n_blocks):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 3))
    labels = np.r_[np.zeros(30), np.ones(29), [2]].astype(int)
    df = vectors(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "idx long, label long"), "idx")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    expected = []
    for i in range(60):
        own = labels == labels[i]
        if own.sum() == 1:
            expected.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == k].mean() for k in set(labels) - {labels[i]})
        expected.append((b - a) / max(a, b))
    assert V.silhouette(df, [], "idx", "x", "label", n_blocks).first()["silhouette"] == pytest.approx(np.mean(expected))


# ---- portfolios -----------------------------------------------------------------------------------------------

def tail_loss(r, p, x, eta, theta, norm):
    loss = -(r @ x)
    order = np.argsort(loss)
    v = loss[order][min(np.searchsorted(np.cumsum(p[order]), eta - 1e-12), len(loss) - 1)]
    return v + p @ np.maximum(loss - v, 0) / (1 - eta) + theta * (x.max() if norm == "l1" else np.linalg.norm(x)) / (1 - eta)


@pytest.mark.parametrize("norm,theta,cap", [("l1", 0.0, 1.0), ("l1", 0.02, 1.0), ("l1", 0.01, 0.3), ("l2", 0.02, 1.0), ("l2", 0.005, 0.4)])
def test_no_random_portfolio_beats_the_optimum(norm, theta, cap):
    rng = np.random.default_rng(10)
    r = rng.normal(0.01, 0.05, (60, 5)) @ (np.eye(5) + 0.3)
    p = rng.dirichlet(np.ones(60))
    s = Z.minimise_tail(r, p, 0.95, theta, cap, norm)
    assert s["ok"] and s["x"].sum() == pytest.approx(1) and s["x"].max() <= cap + 1e-9 and s["x"].min() >= 0
    assert s["objective"] == pytest.approx(tail_loss(r, p, s["x"], 0.95, theta, norm), abs=1e-6)
    others = [x for x in rng.dirichlet(np.ones(5), 4000) if x.max() <= cap]
    near = [np.clip(s["x"] + rng.normal(0, 0.01, 5), 0, None) for _ in range(500)]
    others += [x / x.sum() for x in near if (x / x.sum()).max() <= cap]
    assert min(tail_loss(r, p, x, 0.95, theta, norm) for x in others) >= s["objective"] - 1e-7


@pytest.mark.parametrize("norm,theta,cap", [("l1", 0.0, 1.0), ("l1", 0.02, 1.0), ("l1", 0.01, 0.3), ("l2", 0.02, 1.0), ("l2", 0.005, 0.4), ("l2", 0.01, 0.2)])
def test_multipliers_prove_the_optimum_and_only_the_optimum(spark, norm, theta, cap):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(6):
        p = rng.dirichlet(np.ones(40))
        p[:3] = 0.0 if i % 2 else p[:3]
        rows.append(((rng.normal(0.01, 0.05, (40, 5)) @ (np.eye(5) + 0.3)).tolist(), (p / p.sum()).tolist(), theta))
    solved = Z.optimise(spark.createDataFrame(rows, "r array<array<double>>, p array<double>, theta double"), max_weight=cap, norm=norm, proof=True)
    for row in Z.certificates(solved, max_weight=cap, norm=norm).collect():
        assert row["success"] and row["feasible"] and -1e-9 < row["gap"] < 1e-8
    moved = F.transform("w", lambda w, j: 0.99 * w + F.when(j == 0, 0.01).otherwise(0.0))
    if cap > 0.2:  # else equal weights are all that is allowed
        assert max(r["gap"] for r in Z.certificates(solved.withColumn("w", moved), max_weight=cap, norm=norm).collect()) > 1e-7
    cheat = solved.withColumn("q", F.transform("q", lambda q: 1.01 * q))
    assert not any(r["feasible"] for r in Z.certificates(cheat, max_weight=cap, norm=norm).collect())


def test_unsolvable_rows_have_no_proof(spark):
    df = spark.createDataFrame([([[0.1, 0.2], [0.0, 0.1]], [0.5, 0.5], 0.0)], "r array<array<double>>, p array<double>, theta double")
    row = Z.certificates(Z.optimise(df, max_weight=0.3, proof=True), max_weight=0.3).first()
    assert not row["success"] and not row["feasible"] and row["gap"] is None


def test_unsolvable_rows_follow_the_policy(spark):
    df = spark.createDataFrame([([[0.1, 0.2], [0.0, 0.1]], [0.5, 0.5], 0.0)], "r array<array<double>>, p array<double>, theta double")
    row = Z.optimise(df, max_weight=0.3).first()
    assert not row["success"] and row["w"] == [0.5, 0.5]
    with pytest.raises(Exception, match="no optimal weights"):
        Z.optimise(df, max_weight=0.3, on_failure="raise").collect()


def feed(spark, n=30, k=3, seed=11):
    rng = np.random.default_rng(seed)
    months = [d.date() for d in pd.date_range("2000-01-01", periods=n, freq="MS")]
    states = rng.integers(0, 2, n)
    rows = [("u", m, rng.normal(0.01, 0.05, k).tolist(), int(s), [0.7, 0.3] if s == 0 else [0.2, 0.8]) for m, s in zip(months, states)]
    return rows, spark.createDataFrame(rows, "universe string, month date, r array<double>, state int, p array<double>")


@pytest.mark.parametrize("missing", ["spread", "renormalise"])
def test_scenario_weights_match_a_loop(spark, missing):
    rows, df = feed(spark)
    out = Z.problems(df, ["universe"], 12, 3, [0.05], missing=missing, pi=F.concat(F.try_element_at("train", F.lit(-1))["p"], F.array(F.lit(0.1))))
    got = {(r["strategy"], r["month"]): r for r in out.collect()}
    for i in range(12, 30):
        train = rows[i - 12 : i]
        states = [t[3] for t in train]
        a = np.full((3, 3), 1e-3)
        for s, t in zip(states, states[1:]):
            a[s, t] += 1
        a /= a.sum(1, keepdims=True)
        pi = np.array(train[-1][4] + [0.1])
        w = pi / pi.sum() @ a
        w /= w.sum()
        counts = np.bincount(states, minlength=3)
        p = np.array([w[s] / counts[s] for s in states])
        if missing == "spread":
            p += w[counts == 0].sum() / 12
        p /= p.sum()
        theta = sum(w[s] * 0.05 * counts[s] ** (-1 / 3) for s in range(3) if counts[s])
        theta = theta if missing == "spread" else theta / w[counts > 0].sum()
        row = got[("RSDR", rows[i][1])]
        assert np.allclose(row["p"], p) and row["theta"] == pytest.approx(theta)
        assert got[("DR", rows[i][1])]["theta"] == pytest.approx(0.05 * 12 ** (-1 / 3)) and got[("SAA", rows[i][1])]["theta"] == 0


def test_backtest_rows_and_report(spark):
    rows, df = feed(spark)
    results = Z.backtest(df, ["universe"], 12, 2, [0.01, 0.05]).persist()
    assert results.count() == 18 * 4 * 2
    scored = results.where("strategy = 'SAA' AND gamma = 0.01").select("month", "w", "ret", "objective").collect()
    by_month = {r[1]: r for r in rows}
    assert all(s["ret"] == pytest.approx(float(np.dot(s["w"], by_month[s["month"]][2]))) for s in scored)
    assets = df.select("universe", "month", F.posexplode("r").alias("asset", "ret")).withColumn("asset", F.col("asset").cast("string"))
    report = Z.backtest_report(results, assets, ["universe"], single="0").toPandas()
    assert len(report) == 8 + 2 and report["max_turnover"].notna().sum() == 8


def test_objective_agrees_with_the_sql_score(spark):
    _, df = feed(spark)
    todo = Z.problems(df, ["universe"], 12, 2, [0.05], strategies=["SAA", "RS"])
    solved = Z.optimise(todo.withColumn("r2", F.col("r")).withColumn("p2", F.col("p")))
    losses = F.transform("r2", lambda r: -F.aggregate(F.zip_with(r, "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    out = solved.select("objective", R.weighted_cvar(losses, "p2", 0.95)["cvar"].alias("cvar")).toPandas()
    assert np.allclose(out["objective"], out["cvar"])


def test_missing_values_are_left_out_of_performance(spark):
    months = [d.date() for d in pd.date_range("2000-01-01", periods=6, freq="MS")]
    values = [0.1, None, -0.2, 0.05, 0.0, 0.3]
    df = spark.createDataFrame([("s", m, v) for m, v in zip(months, values)] + [("one", months[0], 0.1)], "strategy string, month date, ret double")
    out = {r["strategy"]: r for r in R.performance(df, ["strategy"]).collect()}
    v = np.array([x for x in values if x is not None])
    wealth = np.cumprod(1 + v)
    assert out["s"]["n_months"] == 5 and out["s"]["final_wealth"] == pytest.approx(wealth[-1])
    assert out["s"]["max_drawdown"] == pytest.approx((wealth / np.maximum.accumulate(wealth) - 1).min())
    assert out["one"]["sharpe"] is None and out["one"]["ann_vol"] is None


# ---- factor panel -----------------------------------------------------------------------------------------------

def test_universes_run_side_by_side(spark):
    """Two universes in one plan give what each gives alone; a missing ticker skips its factor only."""
    from tidepanel.plans import factor_matrix as F_

    rng = np.random.default_rng(12)
    names = [t for t in F_.ALL_TICKERS if t != "PUT"]
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=150)]
    rows = [(u, t, d, float(rng.normal(0, 0.01))) for u in ("a", "b") for t in names for d in days]
    df = spark.createDataFrame(rows, "universe string, series_id string, date date, ret double")
    both = F_.factor_matrix(df, halflife=10, min_periods=20, by=["universe"])
    assert [s[0] for s in both.skipped] == ["Foreign_Currency", "Short_Volatility"]
    alone = F_.factor_matrix(df.where("universe = 'b'").drop("universe"), halflife=10, min_periods=20)
    key = ["factor", "date"]
    x = both.factors.where("universe = 'b'").toPandas().sort_values(key)
    y = alone.factors.toPandas().sort_values(key)
    assert len(x) == len(y) > 0 and np.allclose(x["value"].astype(float), y["value"].astype(float), equal_nan=True)
    with pytest.raises(KeyError):
        F_.complete_vectors(both, ["Nothing"])
    with pytest.raises(KeyError):
        F_.core_factors(df.where("series_id <> 'LUACTRUU'"))
