"""Streams give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest

from tests.test_models import model, vectors
from tidepanel.operators import hmm as H
from tidepanel.operators import mixture as M
from tidepanel.streaming import online as S


def run(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_scores_of_a_stream(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(80, 2))
    fitted = M.fit(vectors(spark, x), M.restarts("m", 2, 1))["m"]
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), row.tolist()) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:5], "idx long, ts timestamp, x array<double>")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(S.score_stream(source, [fitted], "ts", ["idx"]), "scored")
    got = spark.table("scored").orderBy("idx").toPandas()
    expected = M.score(df.dropDuplicates(["idx"]), [fitted]).orderBy("idx").toPandas()
    assert len(got) == 80 and np.allclose(np.stack(got["p"]), np.stack(expected["p"]))


SCHEMA = "entity long, date date, x array<double>"


def filtered_stream(spark, folder, parts, name, **options):
    """Every part is one file and one micro-batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(folder / f"in/{i:02d}"))
        time.sleep(1.1)  # files are taken in the order of their times
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/*"))
    run(S.filter_stream(source, model(), **options), name)
    return spark.table(name).collect()


def days(n, lo=0):
    return [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(lo, lo + n)]


def test_filter_of_a_shuffled_stream_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, d, [float(rng.normal(0, 2))]) for s in range(3) for d in days(24)]
    # each row is up to four days out of order, and a last row far ahead lets the watermark pass all others
    moved = sorted(rows, key=lambda r: (r[1].toordinal() + rng.integers(0, 4), r[0]))
    flush = [(9, dt.date(2024, 6, 1), [0.0])]
    got = filtered_stream(spark, tmp_path, [moved[:20], moved[20:21], moved[21:], flush], "shuffled", delay="5 days")
    found = {(r["entity"], r["date"]): r for r in got}
    blocks = H.to_blocks(spark.createDataFrame(rows, SCHEMA), "entity", "date", "x", 8)
    expected = {(r["seq"], r["date"]): r["p"] for r in H.filtered(blocks, model()).collect()}
    assert len(got) == len(found) and found.keys() == expected.keys()
    assert all(found[k]["p"] == pytest.approx(expected[k]) and found[k]["late"] == 0 for k in found)


def test_late_rows_are_counted_and_old_states_go(spark, tmp_path):
    ahead = [(1, d, [0.5]) for d in days(10)]
    late = [(1, days(1)[0], [9.0]), (1, days(1, 2)[0], [9.0]), (1, days(1, 12)[0], [0.5])]
    again = [(1, dt.date(2024, 9, 1), [0.5])]
    flush = [(9, dt.date(2026, 1, 1), [0.0])]
    rows = filtered_stream(spark, tmp_path, [ahead, late, [(9, dt.date(2024, 8, 1), [0.0])], again, flush], "late", delay="2 days", expire_days=60)
    got = {r["date"]: r for r in rows if r["entity"] == 1}
    assert set(got) == {*days(10), days(1, 12)[0], dt.date(2024, 9, 1)} and got[days(1, 12)[0]]["late"] == 2
    kept = [(1, d, [0.5]) for d in [*days(10), days(1, 12)[0]]]
    expected = {r["date"]: r["p"] for r in H.filtered(H.to_blocks(spark.createDataFrame(kept, SCHEMA), "entity", "date", "x", 8), model()).collect()}
    assert all(got[d]["p"] == pytest.approx(p) for d, p in expected.items())
    alone = model().start * np.exp(model().emissions(np.array([0.5])))
    assert got[dt.date(2024, 9, 1)]["p"] == pytest.approx((alone / alone.sum()).tolist()) and got[dt.date(2024, 9, 1)]["late"] == 0
