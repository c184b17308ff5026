"""Queries go over every universe and penalty, and fits have the stated settings."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tidepanel.plans import views as V

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

PARTS = {
    "regime_stats": "universe", "regime_names": "universe", "regime_relabel": "universe", "state_profile": "universe", "state_feature_matrix": "universe",
    "outer_concat": "universe", "benchmarks": "gamma",
}


@pytest.mark.parametrize("name", PARTS)
def test_every_key_is_there(spark, name):
    key = PARTS[name]
    rows = entry.queries()[name](spark, SF).select(key).distinct().collect()
    all_keys = set(V.GAMMAS) if key == "gamma" else {r.universe for r in V.states_monthly(spark, SF).select("universe").distinct().collect()}
    assert len(all_keys) > 1 and all_keys <= {r[key] for r in rows}


class Seen(Exception):
    pass


@pytest.mark.parametrize("name, per_model, sizes, steps", [
    ("gmm_full", 20, {4}, 1000), ("gmm_diag", 10, {6}, 100), ("gmm_criteria", 10, {2, 3, 4, 5, 6}, 500), ("gmm_cross_validation", 20, {2, 3, 4, 5, 6}, 500), ("walk_forward_mixture", 10, {4}, 500),
])
def test_mixtures_have_the_references_settings(spark, monkeypatch, name, per_model, sizes, steps):
    from collections import Counter

    from tidepanel.operators import mixture as M

    def seen(data, runs, *args, max_iter=100, **rest):
        raise Seen(Counter(run.model for run in runs), {run.k for run in runs}, max_iter)

    monkeypatch.setattr(M, "fit", seen)
    with pytest.raises(Seen) as got:
        entry.queries()[name](spark, SF)
    counts, k, max_iter = got.value.args
    assert set(counts.values()) == {per_model} and k == sizes and max_iter == steps


@pytest.mark.parametrize("name, seeds", [("forest_importance", [0, 1, 2]), ("permutation_importance", [0]), ("importance_mean_rank", [0, 1, 2])])
def test_forests_have_the_references_settings(spark, monkeypatch, name, seeds):
    from tidepanel.operators import importance

    grown, own = [], importance._forest

    def small(data, seed, trees, depth):
        grown.append((seed, trees, depth))
        return own(data, seed, 2, 2)

    monkeypatch.setattr(importance, "_forest", small)
    entry.queries()[name](spark, SF)
    assert grown == [(s, 200, 30) for s in seeds]


@pytest.mark.parametrize("name", ["hmm_fit", "hmm_viterbi", "hmm_filter", "state_export", "engine_grid"])
def test_chains_have_the_references_settings(spark, monkeypatch, name):
    import inspect

    from tidepanel.operators import hmm

    own = inspect.signature(hmm.fit)

    def seen(*args, **rest):
        bound = own.bind(*args, **rest)
        bound.apply_defaults()
        raise Seen(bound.arguments["runs"][0].k, bound.arguments["max_iter"])

    monkeypatch.setattr(hmm, "fit", seen)
    with pytest.raises(Seen) as got:
        entry.queries()[name](spark, SF)
    assert got.value.args == (6, 20)
