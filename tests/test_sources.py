"""Readers and writers on small files."""

from __future__ import annotations

import datetime as dt

import pytest

from tidepanel.sources import readers as S
from tidepanel.sources import writers as W


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_prices_take_names_from_the_catalogue(spark, tmp_path):
    put(tmp_path, "AAA_Long_Name.csv", "Date,Price\n2024-01-02,1.5\n45294,2.5\n2024-01-03,3.5\nbad,9\n")
    put(tmp_path, "BBB_Other.csv", "Date,Price\n2024-01-02,x\n")
    catalog = put(tmp_path, "cat.txt", "index_name,file_name,index_short_name,ticker,region,category,start_date,end_date\nn,AAA_Long_Name.xlsx,s,AAA Index,r,c,,\n")
    out = S.read_prices(spark, [str(tmp_path / "AAA_Long_Name.csv"), str(tmp_path / "BBB_Other.csv")], S.read_catalog(spark, catalog))
    # 45294 is 2024-01-03; the later line wins
    assert rows(out, "date") == [("AAA", dt.date(2024, 1, 2), 1.5), ("AAA", dt.date(2024, 1, 3), 3.5)]
    plain = S.read_prices(spark, str(tmp_path / "AAA_Long_Name.csv"), daily_from={"AAA": "2024-01-03"}, daily_only=True)
    assert rows(plain, "date") == [("AAA", dt.date(2024, 1, 3), 3.5)]


def test_factor_files(spark, tmp_path):
    head = "made up\nlines\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n"
    daily = put(tmp_path, "d.csv", head + "20240102,1.0,2.0,3.0,4.0,5.0,0.01\n20240102,2.0,2.0,3.0,4.0,5.0,0.01\n")
    monthly = put(tmp_path, "m.csv", head + "202402,1.0,2.0,3.0,4.0,5.0,0.01\n")
    got = {r["series_id"]: (r["date"], r["value"]) for r in S.read_factors(spark, daily).collect()}
    assert got["Mkt_RF"] == (dt.date(2024, 1, 2), 0.02) and len(got) == 6
    assert {r["date"] for r in S.read_factors(spark, monthly, monthly=True).collect()} == {dt.date(2024, 2, 29)}


def test_wide_files(spark, tmp_path):
    rates = put(tmp_path, "r.csv", "date,dff,dtb3\n2024-01-02,5.3,.\n2024-01-03,,5.1\n")
    assert rows(S.read_wide_dates(spark, rates, "date"), "date") == [(dt.date(2024, 1, 2), "dff", 5.3), (dt.date(2024, 1, 3), "dtb3", 5.1)]
    fx = put(tmp_path, "fx.csv", "Date,EURUSD BGN Curncy,Other\n2024-01-02,1.1,7\n")
    assert rows(S.read_currencies(spark, fx), "date") == [(dt.date(2024, 1, 2), "EURUSD", 1.1)]
    gdp = put(tmp_path, "g.csv", "Year,New Zealand,Japan\n1980,22.5,1129\n")
    assert rows(S.read_annual(spark, gdp), "series_id") == [(1980, "Japan", 1129.0), (1980, "New Zealand", 22.5)]


def test_macro_file_with_code_row(spark, tmp_path):
    path = put(tmp_path, "macro.csv", "sasdate,RPI,S&P 500\nTransform:,5,2\n1/1/1959,2442.1,55.6\n2/1/1959,,54.8\n")
    data, codes = S.read_macro(spark, path)
    assert rows(codes, "series_id") == [("RPI", 5), ("S&P 500", 2)]
    assert rows(data, "date", "series_id") == [(dt.date(1959, 1, 1), "RPI", 2442.1), (dt.date(1959, 1, 1), "S&P 500", 55.6), (dt.date(1959, 2, 1), "S&P 500", 54.8)]


def test_flags_codes_and_states(spark, tmp_path):
    flag = put(tmp_path, "f.csv", "observation_date,USREC\n1854-12-01,1\n1855-01-15,0\n1855-02-01,\n")
    assert rows(S.read_flag(spark, flag), "month") == [(dt.date(1854, 12, 1), 1), (dt.date(1855, 1, 1), 0)]
    codes = put(tmp_path, "c.csv", "column,tcode\nBLM_X,1\n")
    assert rows(S.read_codes(spark, codes), "series_id") == [("BLM_X", 1)]
    states = put(tmp_path, "s.csv", "sasdate,state,p_state1,p_state0\n2024-01-15,1,0.3,0.1\n2024-02-15,0,,\n")
    got = S.read_states(spark, states).orderBy("month").collect()
    assert got[0]["p"] == pytest.approx([0.25, 0.75]) and got[1]["p"] == [0.5, 0.5] and got[0]["crisis"] is None


def test_manifest_and_round_trip(spark, tmp_path):
    put(tmp_path, "a.txt", "hello")
    got = S.manifest(spark, str(tmp_path), ["a.txt"]).first()
    assert got["sha256"] == "2cf24dba5fb0"
    with pytest.raises(Exception, match="required input missing"):
        S.manifest(spark, str(tmp_path), ["a.txt", "b.txt"]).collect()
    df = spark.createDataFrame([("u", 1, [0.5, 0.5]), ("v", 2, [1.0])], "run_id string, k long, w array<double>")
    W.write_all({"t": df}, str(tmp_path / "out"), partition_by={"t": ["run_id"]})
    back = S.read_parquet(spark, str(tmp_path / "out" / "t")).select("run_id", "k", "w")
    assert rows(back, "run_id") == rows(df, "run_id")
    W.write_table(df, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
