"""Forests: the same trees however they are grown, and permuted accuracies by brute force."""

from __future__ import annotations

import numpy as np
import pytest

from tidepanel.operators import forest as W
from tidepanel.operators import importance as I


def labelled(spark, n=600, d=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 1] = rng.integers(0, 3, n)
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] == 2)
    return x, y, spark.createDataFrame([(v.tolist(), float(c)) for v, c in zip(x, y)], "x array<double>, label double")


def trees_of(model):
    lower: dict = {}
    for r in model.parts.collect():
        read = lambda c, kind: np.frombuffer(r[c], kind)
        lower.setdefault(r["tree"], {})[r["node"]] = W.Part(read("feature", np.int16), read("cut", np.uint8), read("child", np.int32), read("votes", np.float32).reshape(-1, model.classes))
    return [W._whole(top, lower.get(i, {})) for i, top in enumerate(model.tops)]


def test_a_tree_is_the_same_wherever_it_is_split(spark, monkeypatch):
    """Split from counts of all tasks, or in one task; and from other partitions."""
    x, _, df = labelled(spark)
    local = W.grow(W.binned(df, "x", "label"), 1, 6, 30)
    monkeypatch.setattr(W, "LOCAL_ROWS", 60)
    spread = W.grow(W.binned(df.repartition(5), "x", "label"), 1, 6, 30)
    assert all(len(t.feature) == 1 for t in local.tops) and all(len(t.feature) > 3 for t in spread.tops)
    assert np.allclose(local.gains, spread.gains)
    bins = W.bins_of(x, local.ends)
    for a, b in zip(trees_of(local), trees_of(spread)):
        assert np.allclose(a.votes[W._walked(a, bins)], b.votes[W._walked(b, bins)])


def test_forests_learn_the_rule_and_leaves_are_large_enough(spark):
    x, y, df = labelled(spark)
    model = W.grow(W.binned(df, "x", "label"), 0, 20, 30)
    bins = W.bins_of(x, model.ends)
    votes = sum(t.votes[W._walked(t, bins)] for t in trees_of(model))
    assert (votes.argmax(axis=1) == y).mean() > 0.97
    share = model.importances()
    assert share.sum() == pytest.approx(1) and share[:2].sum() > 0.8
    rows = W.binned(df, "x", "label").rows.toPandas()
    for i, tree in enumerate(trees_of(model)):
        own = W._matrix(rows["bins"], 5)
        weight = W._weights(rows["idx"].to_numpy(), 0, i)
        ends = W._walked(tree, own)
        assert min(weight[ends == e].sum() for e in np.unique(ends[weight > 0])) >= W.LEAST
    assert sorted(rows["idx"]) == list(range(600))


def test_permuted_accuracies_equal_whole_walks(spark):
    x, y, df = labelled(spark, 300)
    model = W.grow(W.binned(df, "x", "label"), 0, 8, 30)
    rows = I.partnered(df, "x", "label", 0, 2).persist()
    got = {(r["feature"], r["repeat"]): (r["hits"], r["n"]) for r in W.swapped_hits(model, rows, 2, rows_per_group=90).collect()}
    held, trees = rows.toPandas(), trees_of(model)
    own, label = np.stack(held["x"]), held["label"].to_numpy()

    def hits(values):
        bins = W.bins_of(values, model.ends)
        return int((sum(t.votes[W._walked(t, bins)].astype(float) for t in trees).argmax(axis=1) == label).sum())

    assert got[-1, 0] == (hits(own), 300) and len(got) == 11
    for j in range(5):
        for r in range(2):
            changed = own.copy()
            changed[:, j] = np.stack([p[r] for p in held["partners"]])[:, j]
            assert got[j, r] == (hits(changed), 300)


def test_what_a_forest_cannot_use_is_refused(spark):
    for row in (([1.0, None], 0.0), ([1.0, float("nan")], 0.0), ([1.0, 2.0], None), (None, 1.0)):
        with pytest.raises(ValueError, match="a forest needs"):
            W.binned(spark.createDataFrame([([0.0, 1.0], 1.0), row], "x array<double>, label double"), "x", "label")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_is_dealt_out_per_tree_and_no_tree_per_group(spark):
    """Rows and trees are read where they are stored: copies of either would grow with the number of trees or groups."""
    _, _, df = labelled(spark)
    model = W.grow(W.binned(df, "x", "label"), 0, 3, 30)
    assert "hashpartitioning(tree" not in planned(model.parts)
    hits = planned(W.swapped_hits(model, I.partnered(df, "x", "label", 0, 2), 2, rows_per_group=90))
    assert "hashpartitioning(g" not in hits and "CoGroup" not in hits


@pytest.mark.parametrize("local", [60_000, 30])
def test_forests_are_the_same_from_blocks_and_from_dealt_rows(spark, monkeypatch, local):
    _, _, df = labelled(spark)
    rows = I.partnered(df, "x", "label", 0, 2)
    monkeypatch.setattr(W, "LOCAL_ROWS", local)

    def grown():
        model = W.grow(W.binned(df, "x", "label"), 2, 6, 30)
        assert all((t.feature == -2).sum() > 1 for t in model.tops) == (local == 30)
        return model.gains, trees_of(model), sorted(map(tuple, W.swapped_hits(model, rows, 2, rows_per_group=100).collect()))

    gains, trees, hits = grown()
    monkeypatch.setattr(W, "SHARED_BYTES", 0)
    other = grown()
    assert np.allclose(gains, other[0]) and hits == other[2]
    bins = W.bins_of(labelled(spark)[0], W.binned(df, "x", "label").ends)
    assert all(np.array_equal(a.votes[W._walked(a, bins)], b.votes[W._walked(b, bins)]) for a, b in zip(trees, other[1]))


def test_permuting_bins_equals_permuting_vectors(spark):
    _, _, df = labelled(spark, 300)
    model = W.grow(W.binned(df, "x", "label"), 5, 8, 30)
    acc = {(r["feature"], r["repeat"]): r["hits"] / r["n"] for r in W.swapped_hits(model, I.partnered(df, "x", "label", 5, 2), 2).collect()}
    got = {r["feature"]: r["drop"] for r in I.permutation_importance(df, "x", "label", seed=5, repeats=2, trees=8).collect()}
    assert got == pytest.approx({j: acc[-1, 0] - (acc[j, 0] + acc[j, 1]) / 2 for j in range(5)})


def test_trees_that_end_above_their_parts_are_counted(spark, monkeypatch):
    x, _, _ = labelled(spark, 200)
    df = spark.createDataFrame([(v.tolist(), 0.0) for v in x], "x array<double>, label double")
    monkeypatch.setattr(W, "LOCAL_ROWS", 20)
    model = W.grow(W.binned(df, "x", "label"), 0, 4, 30)
    assert model.parts.count() == 0
    assert {(r["hits"], r["n"]) for r in W.swapped_hits(model, I.partnered(df, "x", "label", 0, 2), 2).collect()} == {(200, 200)}
