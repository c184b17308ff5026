"""Side-by-side run of a registered query and its SQL on the same tables."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


def compare(spark, query, sql: str, sf_dir: str, con=None) -> dict:
    con = con or connect(sf_dir)
    t0 = time.time()
    df = query(spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    theirs_raw = cur.fetchall()
    t2 = time.time()
    cols = sorted(df.columns)
    out = {"rows": len(rows), "oracle_rows": len(theirs_raw), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if cols != sorted(theirs_cols):
        return {**out, "ok": False, "why": f"columns {cols} vs {sorted(theirs_cols)}"}
    pick = [theirs_cols.index(c) for c in cols]
    mine = sorted((tuple(_plain(r[c]) for c in cols) for r in rows), key=_key)
    theirs = sorted((tuple(_plain(r[i]) for i in pick) for r in theirs_raw), key=_key)
    if len(mine) != len(theirs):
        return {**out, "ok": False, "why": "row count"}
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return {**out, "ok": False, "why": f"{len(bad)} rows differ, e.g. {cols} {bad[0][0]} vs {bad[0][1]}"}
    return {**out, "ok": True}


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tidepanel.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("sf"):
        sf = f"/root/testdata/{args.pop(0)}"
    con = connect(sf)
    names = [n for n in entry.queries() if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    failed = 0
    for name in names:
        try:
            if name in entry.oracle_sql():
                res = compare(spark, entry.queries()[name], entry.oracle_sql()[name], sf, con)
            else:
                t0 = time.time()
                rows = entry.queries()[name](spark, sf).collect()
                res = {"rows": len(rows), "ok": bool(rows), "spark_s": round(time.time() - t0, 2), "oracle": None, "first": str(rows[:1])[:300]}
        except Exception as e:  # noqa: BLE001
            res = {"ok": False, "why": f"{type(e).__name__}: {str(e)[:700]}"}
        failed += not res["ok"]
        print("ok  " if res["ok"] else "FAIL", name, {k: v for k, v in res.items() if k != "ok"}, flush=True)
    print(len(names), "queries,", failed, "failed")
    sys.stdout.flush()
