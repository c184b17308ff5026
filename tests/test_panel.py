"""Edge cases of alignment and ordered transforms on hand-written tables."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import expr as E
from tidepanel.functions import ordered as O
from tidepanel.operators import moments as N
from tidepanel.operators import panel as P
from tidepanel.operators import sequences as Q
from tidepanel.operators import stats as S


def series(spark, values, start="2024-01-01", name="a"):
    days = pd.bdate_range(start, periods=len(values))
    return spark.createDataFrame([(name, d.date(), None if v is None else float(v)) for d, v in zip(days, values)], "series_id string, date date, price double")


def column(df, name="price"):
    return [r[name] for r in df.orderBy("date").collect()]


def test_fill_stops_at_its_limit(spark):
    out = P.align_to_calendar(series(spark, [1.0] + [None] * 8 + [2.0]), ["series_id"], "price", "2024-01-01", "2024-01-12")
    assert column(out) == [1.0] * 6 + [None] * 3 + [2.0]


def test_leading_days_are_missing_and_weekends_dropped(spark):
    raw = series(spark, [5.0], start="2024-01-04").unionByName(
        spark.createDataFrame([("a", dt.date(2024, 1, 6), 9.0)], "series_id string, date date, price double"))
    out = P.align_to_calendar(raw, ["series_id"], "price", "2024-01-01", "2024-01-09", limit=1)
    assert column(out) == [None, None, None, 5.0, 5.0, None, None]


def test_nothing_crosses_the_daily_start(spark):
    raw = series(spark, [1.0], start="2024-01-31").unionByName(series(spark, [2.0], start="2024-02-08"))
    raw = raw.withColumn("daily_from", F.lit("2024-02-06").cast("date"))
    out = P.align_to_calendar(raw, ["series_id"], "price", "2024-01-31", "2024-02-09", daily_from="daily_from")
    assert column(out) == [1.0] * 4 + [None] * 2 + [2.0, 2.0]


def test_only_long_flat_runs_are_removed(spark):
    out = P.strip_stale(series(spark, [1.0] * 9 + [2.0]), ["series_id"], "price")
    assert column(out) == [1.0] * 6 + [None] * 3 + [2.0]


def test_interpolation_takes_the_nearest_value_at_the_ends(spark):
    df = O.with_position(series(spark, [None, 2.0, None, None, 5.0, None]), ["series_id"])
    out = df.withColumn("price", O.interpolated("price", ["series_id"]))
    assert column(out) == [2.0, 2.0, 3.0, 4.0, 5.0, 5.0]


def test_limited_fill_matches_pandas(spark):
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.6 else float(i) for i in range(200)]
    df = O.with_position(series(spark, values), ["series_id"])
    out = column(df.withColumn("price", O.forward_fill("price", O.by(["series_id"]), 3, "position")))
    expected = pd.Series(values, dtype=float).ffill(limit=3)
    assert [np.nan if v is None else v for v in out] == pytest.approx(expected.tolist(), nan_ok=True)


def test_long_rolling_matches_pandas(spark):
    rng = np.random.default_rng(2)
    values = [None if rng.random() < 0.2 else float(v) for v in rng.normal(0, 0.01, 300)]
    out = O.with_long_rolling(series(spark, values), ["series_id"], "price", 60, 30, total="s", std="d").orderBy("date").toPandas()
    v = pd.Series(values, dtype=float)
    assert np.allclose(out["s"].astype(float), v.rolling(60, min_periods=30).sum(), equal_nan=True)
    assert np.allclose(out["d"].astype(float), v.rolling(60, min_periods=30).std(), equal_nan=True)


def test_unknown_code_raises(spark):
    df = series(spark, [1.0, 2.0]).withColumn("tcode", F.lit(9))
    with pytest.raises(Exception, match="unknown transform code"):
        df.withColumn("v", O.transform_by_code("price", "tcode", O.by(["series_id"]))).collect()


def test_missing_role_raises(spark):
    with pytest.raises(Exception, match="no series available"):
        P.first_available(series(spark, [1.0]), {"equity": ["x", "y"]}).collect()


def test_month_end_signal_holds_until_the_next_one(spark):
    df = series(spark, [float(i) for i in range(45)], start="2024-01-15")
    out = P.month_end_hold(df, ["series_id"], "price").orderBy("date").toPandas().set_index("date")["price"]
    assert np.isnan(out[dt.date(2024, 1, 30)])
    assert out[dt.date(2024, 1, 31)] == 12.0 and out[dt.date(2024, 2, 28)] == 12.0
    assert out[dt.date(2024, 2, 29)] == 33.0 and out[dt.date(2024, 3, 1)] == 33.0


def test_ties_share_their_mean_rank(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", 0.0)], "k string, v double")
    ranks = {r["k"]: r["r"] for r in df.select("k", O.average_rank("v", []).alias("r")).collect()}
    assert ranks == {"a": 1.5, "c": 1.5, "b": 3.0, "d": 4.0}


def test_mixed_dates(spark):
    df = spark.createDataFrame([("2024-02-29",), ("45351",), ("junk",), (None,)], "d string")
    assert [r[0] for r in df.select(E.parse_mixed_date("d")).collect()] == [dt.date(2024, 2, 29), dt.date(2024, 2, 29), None, None]


@pytest.mark.parametrize("blocks", [None, 1, 7, 1000])
def test_sequence_results_do_not_depend_on_the_blocks(spark, blocks):
    """One sequence owns most rows, and half of all rows share one second."""
    rng = np.random.default_rng(3)
    times = np.where(rng.random(400) < 0.5, 7200, rng.integers(0, 5 * 86400, 400))
    rows = [(int(s), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(t)), i, int(rng.integers(3))) for i, (s, t) in enumerate(zip(rng.choice([1, 1, 1, 2], 400), times))]
    df = spark.createDataFrame(rows, "seq_id long, ts timestamp, event_id long, state long")
    pdf = pd.DataFrame(rows, columns=["seq", "ts", "id", "state"]).sort_values(["seq", "ts", "id"])
    pdf["next"] = pdf.groupby("seq")["state"].shift(-1)
    expected = pdf.dropna().groupby(["state", "next"]).size().to_dict()
    counts = Q.transition_counts(df, ["seq_id"], ["ts", "event_id"], "state", blocks=blocks).collect()
    assert {(r["from_state"], r["to_state"]): r["n"] for r in counts} == expected
    runs = Q.periods(df, ["seq_id"], ["ts", "event_id"], "state", "ts", blocks).toPandas().sort_values(["seq_id", "run_id"])
    changes = (pdf["state"] != pdf.groupby("seq")["state"].shift()).groupby(pdf["seq"]).sum()
    assert runs.groupby("seq_id").size().tolist() == changes.tolist() and runs["n_rows"].sum() == len(pdf)
    near = Q.with_neighbour(Q.with_block(df, ["seq_id"], ["ts", "event_id"], blocks), ["seq_id"], ["ts", "event_id"], "state", "before").toPandas().set_index("event_id")["before"]
    before = pdf.groupby("seq")["state"].shift().set_axis(pdf["id"])
    assert near.sort_index().fillna(-1).tolist() == before.sort_index().fillna(-1).tolist()


def test_exact_quantiles_of_any_distribution(spark):
    rng = np.random.default_rng(4)
    values = {
        "normal": rng.normal(size=4000), "ties": rng.integers(-2, 5, 3000).astype(float), "one": np.array([7.0]), "two": np.array([-1.0, 3.0]),
        "far": 1e8 + rng.normal(size=2000), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 500), -(10.0 ** rng.uniform(-300, 300, 500)), [0.0, -0.0]]),
        "close": 1.0 + np.arange(500) * 2.0**-52, "constant": np.full(50, 0.1), "ends": np.array([-np.inf, 1.0, 2.0, 3.0, np.inf]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs] + [("normal", None)], "k string, v double").repartition(6)
    probs, names = [0.0, 0.1, 0.5, 0.85, 1.0], list("mpqrx")
    out = {r["k"]: r for r in S.exact_quantiles(df, ["k"], "v", probs, names).collect()}
    for k, vs in values.items():
        at = np.array(probs) * (len(vs) - 1)
        low, ordered = np.floor(at).astype(int), np.sort(vs)
        for name, i, share in zip(names, low, at - low):
            expected = ordered[i] if share == 0 else ordered[i] + (ordered[i + 1] - ordered[i]) * share
            assert out[k][name] == pytest.approx(expected, rel=1e-12, nan_ok=True), (k, name)
    row = S.exact_quantiles(df.where("k = 'far'"), [], "v", [0.5], ["q"]).collect()
    assert len(row) == 1 and row[0]["q"] == pytest.approx(np.median(values["far"]), rel=1e-15)
    assert S.exact_quantiles(df.where("k = 'none'"), ["k"], "v", [0.5], ["q"]).count() == 0


def test_adjusted_rand_of_equal_and_renamed_labels(spark):
    df = spark.createDataFrame([(i, i % 3, (i + 1) % 3) for i in range(30)], "i long, a long, b long")
    assert S.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1.0)
    keyed = S.adjusted_rand(df.withColumn("g", F.col("i") % 2), "a", "b", ["g"]).collect()
    assert {r["g"]: (r["n"], r["ari"]) for r in keyed} == {0: (15, pytest.approx(1.0)), 1: (15, pytest.approx(1.0))}


def test_pair_moments_skip_missing_cells(spark):
    df = spark.createDataFrame([([1.0, 2.0, None],), ([2.0, 1.0, 4.0],), ([4.0, 0.5, 1.0],)], "x array<double>")
    out = {(r["i"], r["j"]): r for r in N.correlation_pairs(df, "x").collect()}
    pdf = pd.DataFrame([[1, 2, np.nan], [2, 1, 4], [4, 0.5, 1]])
    assert out[(0, 2)]["n"] == 2 and out[(0, 1)]["corr"] == pytest.approx(pdf[0].corr(pdf[1])) and out[(0, 2)]["cov"] == pytest.approx(pdf[0].cov(pdf[2]))
