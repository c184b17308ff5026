"""Factor construction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import ordered as O
from tidepanel.functions.expr import rounded
from tidepanel.operators import factors as X
from tidepanel.operators import panel as P
from tidepanel.plans import engineered as G
from tidepanel.plans import factor_matrix as M
from tidepanel.plans import views as V
from tidepanel.plans.oracle_views import r, sql
from tidepanel.plans.queries_panel import rnd
from tidepanel.plans.registry import query
from tidepanel.sources import shaping as H

# The brand series stand in for index tickers, in order, and for style series after them.
TICKERS = {f"Brand#{i + 1}": t for i, t in enumerate(M.ALL_TICKERS)}
STYLES = {f"Brand#{19 + i}": s for i, s in enumerate(M.STYLE_FACTORS)}
FLIPPED = ["Brand#2", "Brand#4", "Brand#8"]


def ticker_returns(spark, sf):
    return H.rename_known(V.returns(spark, sf), TICKERS)


def style_returns(spark, sf):
    return H.rename_known(V.returns(spark, sf), STYLES)


def pair_weights(spark, sf):
    """Yearly output of one nation per brand, as weights of the following year."""
    annual = V.annual_weights(spark, sf).withColumn("series_id", F.concat(F.lit("Brand#"), (F.col("nationkey") + 1).cast("string")))
    return X.daily_weights(X.output_weights(annual, "series_id", "gdp"), "series_id", V.START, V.END)


def basket(spark, sf):
    return X.currency_basket(V.prices(spark, sf), pair_weights(spark, sf), "series_id", FLIPPED, V.START, V.END)


# ---- exponentially weighted residual --------------------------------------------------------

_XY = """SELECT a.series_id, a.date, a.ret AS y, b.ret AS x, row_number() OVER (PARTITION BY a.series_id ORDER BY a.date) - 1 AS t
    FROM returns a JOIN returns b ON a.date = b.date AND b.series_id = 'Brand#1' WHERE a.series_id <> 'Brand#1' AND a.ret IS NOT NULL AND b.ret IS NOT NULL"""
_SUMS = """SELECT *, pow(2.0::DOUBLE, -(t - 1) / 60.0::DOUBLE) AS s, pow(0.5::DOUBLE, t / 60.0::DOUBLE) * 1e-8 AS rr, """ + ", ".join(
    f"sum({e} * pow(2.0::DOUBLE, t / 60.0::DOUBLE)) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS {n}"
    for n, e in (("s0", "1"), ("sx", "x"), ("sxx", "x * x"), ("sy", "y"), ("sxy", "x * y"))) + " FROM xy"
_FIT = "SELECT *, s0 * s + rr AS a, sx * s AS b, sxx * s + rr AS c, sy * s AS d, sxy * s AS e FROM sums"


@query("ew_residual_k1", sql(f"""SELECT series_id, date, CASE WHEN t >= 126 THEN {r('y - (c * d - b * e) / (a * c - b * b) - x * (a * e - b * d) / (a * c - b * b)')} END AS resid FROM fit""",
    "returns", xy=_XY, sums=_SUMS, fit=_FIT))
def ew_residual_k1(spark, sf):
    """Every series net of the first one."""
    returns = V.returns(spark, sf)
    x = returns.where((F.col("series_id") == "Brand#1") & F.col("ret").isNotNull()).select("date", F.array("ret").alias("x"))
    data = returns.where(F.col("series_id") != "Brand#1").withColumnRenamed("ret", "y").join(P.per_date(x), "date")
    return rnd(X.ew_residual(data, ["series_id"], 1), "resid")


@query("ew_residual_multi")
def ew_residual_multi(spark, sf):
    """Every other series net of three; checked in the tests against a per-row regression."""
    returns = V.returns(spark, sf)
    names = ["Brand#1", "Brand#2", "Brand#3"]
    x = returns.where(F.col("series_id").isin(*names)).groupBy("date").agg(F.array(*[F.max(F.when(F.col("series_id") == n, F.col("ret"))) for n in names]).alias("x"))
    data = returns.where(~F.col("series_id").isin(*names)).withColumnRenamed("ret", "y").join(P.per_date(x), "date")
    return rnd(X.ew_residual(data, ["series_id"], 3), "resid")


# ---- mixes, momentum, baskets -----------------------------------------------------------------

_R252 = "(PARTITION BY series_id ORDER BY date ROWS 251 PRECEDING)"
_LIVE = "SELECT * FROM returns WHERE date IN (SELECT date FROM returns WHERE ret IS NOT NULL)"
_VOL = f"SELECT *, CASE WHEN count(ret) OVER {_R252} >= 126 THEN stddev_samp(ret) OVER {_R252} END AS vol FROM live"


@query("inverse_vol_combine", sql(f"SELECT date, {r('sum(ret / vol) / sum(1 / vol)')} AS value FROM vols GROUP BY date", "returns", live=_LIVE, vols=_VOL))
def inverse_vol_combine(spark, sf):
    panel = V.returns(spark, sf).withColumn("factor", F.lit("MIX"))
    return rnd(X.inverse_vol_mix(panel, ["factor"], "series_id").select("date", "value"), "value")


_SIGN = f"""SELECT *, sign(CASE WHEN count(ret) OVER {_R252} >= 126 THEN sum(ret) OVER {_R252} END) AS sg FROM returns"""
_HELD = """SELECT p.*, coalesce(c.sg, 0) AS held FROM signs p LEFT JOIN (SELECT series_id, last_day(date) AS stamp, arg_max(sg, date) AS sg FROM signs
    WHERE sg IS NOT NULL GROUP BY ALL) c ON c.series_id = p.series_id
    AND c.stamp = CASE WHEN p.date = last_day(p.date) THEN p.date ELSE last_day(CAST(p.date - INTERVAL 1 MONTH AS DATE)) END"""


@query("time_series_momentum", sql(f"SELECT date, {r('sum(held * ret) / nullif(count(*) FILTER (held <> 0), 0)')} AS value FROM held GROUP BY date", "returns", signs=_SIGN, held=_HELD))
def time_series_momentum(spark, sf):
    panel = V.returns(spark, sf).withColumn("factor", F.lit("TREND"))
    return rnd(X.momentum(panel, ["factor"], "series_id").select("date", "value"), "value")


_SHARES = """SELECT member, make_date(CAST(year + 1 AS INT), 1, 1) AS date, v / sum(v) OVER (PARTITION BY year) AS weight FROM
    (SELECT year, {m} AS member, sum(gdp) AS v FROM annual_weights GROUP BY ALL)"""
_DAILY = """SELECT m.member, c.date, coalesce(s.weight, first_value(s.weight IGNORE NULLS) OVER (PARTITION BY m.member ORDER BY c.date
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS weight FROM (SELECT DISTINCT member FROM shares) m CROSS JOIN calendar c
    ASOF LEFT JOIN shares s ON s.member = m.member AND c.date >= s.date"""


@query("gdp_weights", sql(f"SELECT member AS bloc, date, {r('weight')} AS weight FROM daily", "annual_weights", "calendar", shares=_SHARES.format(m="bloc"), daily=_DAILY))
def gdp_weights(spark, sf):
    shares = X.output_weights(V.annual_weights(spark, sf), "bloc", "gdp")
    return rnd(X.daily_weights(shares, "bloc", V.START, V.END).select("bloc", "date", "weight"), "weight")


_MOVES = """SELECT series_id, date, CASE WHEN series_id IN ('Brand#2', 'Brand#4', 'Brand#8') THEN -1 ELSE 1 END *
    ln(price / lag(price) OVER (PARTITION BY series_id ORDER BY date)) AS r FROM dense_prices WHERE price IS NOT NULL"""


@query("fx_basket", sql(f"""SELECT d.date, {r('sum(m.r * d.weight) / sum(d.weight)')} AS value FROM daily d LEFT JOIN moves m ON m.series_id = d.member AND m.date = d.date
    WHERE d.date IN (SELECT date FROM moves) GROUP BY d.date""", "annual_weights", "dense_prices", shares=_SHARES.format(m="'Brand#' || (nationkey + 1)"), daily=_DAILY, moves=_MOVES))
def fx_basket(spark, sf):
    return rnd(basket(spark, sf), "value")


_SRC = """SELECT date, arg_min(rate, k) AS rate FROM (SELECT date, price / 1000 AS rate, CASE series_id WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 WHEN 'Brand#3' THEN 3 END AS k
    FROM prices WHERE series_id IN ('Brand#1', 'Brand#2', 'Brand#3')) GROUP BY date"""
_BILL = """SELECT last_day(month) AS date, (pow(1 + value / 1e10, 4) - 1) * 100 AS bill FROM macro_monthly WHERE series_id = 'TOTAL' AND month(month) % 3 = 0"""
_RF = """SELECT c.date, c.bidx, coalesce(s.rate, b.bill) AS rate FROM calendar c LEFT JOIN src s ON s.date = c.date ASOF LEFT JOIN bills b ON c.date >= b.date"""


@query("risk_free_stitch", sql(f"""SELECT date, {r('pow(1 + last_value(rate IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) / 100, 1.0 / 252) - 1', 9)} AS rf FROM stitched""",
    "prices", "macro_monthly", "calendar", src=_SRC, bills=_BILL, stitched=_RF))
def risk_free_stitch(spark, sf):
    names = ["Brand#1", "Brand#2", "Brand#3"]
    daily = V.prices(spark, sf).where(F.col("series_id").isin(*names)).select(F.col("series_id").alias("source"), "date", (F.col("price") / 1000).alias("rate"))
    macro = V.macro_monthly(spark, sf).where((F.col("series_id") == "TOTAL") & (F.month("month") % 3 == 0))
    return rnd(X.risk_free(daily, macro.select(F.last_day("month").alias("date"), (F.col("value") / 1e10).alias("rate")), names, V.START, V.END), "rf", digits=9)


# ---- whole factor panel ---------------------------------------------------------------------------

_STARTS = " ".join(f"WHEN '{t}' THEN DATE '{d}'" for t, d in M.DAILY_FROM.items())
_NAMES = ", ".join(f"('{b}', '{t}')" for b, t in TICKERS.items())
_CARRY = ", ".join(f"'{t}'" for t in M.HOLIDAY_CARRY)
_SECTION = f"""SELECT m.ticker AS series_id, g.date, g.price, coalesce(g.date >= CASE m.ticker {_STARTS} END, true) AS daily FROM reindexed g JOIN (VALUES {_NAMES}) m(brand, ticker) ON m.brand = g.series_id"""
_S = "PARTITION BY series_id, daily ORDER BY date"
_CARRIED = f"""SELECT *, CASE WHEN daily THEN last_value(price IGNORE NULLS) OVER ({_S} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) ELSE last_value(price IGNORE NULLS) OVER ({_S} ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) END AS filled FROM section"""
_FRESH = f"SELECT *, CASE WHEN filled = lag(filled) OVER ({_S}) THEN NULL ELSE filled END AS fresh FROM carried"


@query("clean_prices_panel", sql(f"""SELECT series_id, date, {r(f"CASE WHEN daily AND series_id IN ({_CARRY}) THEN last_value(fresh IGNORE NULLS) OVER ({_S} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) ELSE filled END")} AS price FROM fresh""",
    "reindexed", section=_SECTION, carried=_CARRIED, fresh=_FRESH))
def clean_prices_panel(spark, sf):
    """Mixed-frequency fill and stale-run removal for all mapped tickers."""
    return rnd(M.clean_prices(H.rename_known(V.prices(spark, sf), TICKERS), V.START, V.END), "price")


@query("core_factors")
def core_factors(spark, sf):
    return rnd(M.core_factors(ticker_returns(spark, sf)).factors, "value")


@query("secondary_factors")
def secondary_factors(spark, sf):
    returns = ticker_returns(spark, sf)
    return rnd(M.secondary_factors(returns, M.core_factors(returns), basket(spark, sf)).factors, "value")


@query("style_factors")
def style_factors(spark, sf):
    return rnd(M.style_factors(style_returns(spark, sf), M.core_factors(ticker_returns(spark, sf))).factors, "value")


@query("factor_matrix")
def factor_matrix(spark, sf):
    return rnd(M.factor_matrix(ticker_returns(spark, sf), style_returns(spark, sf), basket(spark, sf)).factors, "value").select("factor", "date", "value")


# ---- engineered monthly features --------------------------------------------------------------------

MACRO_NAMES = {n: f"Brand#{i + 1}" for i, n in enumerate(G.INPUTS)}
_SHORT = ["gs10", "tb3", "gs1", "gs5", "ff", "baa", "aaa", "cpi", "un", "pe", "sp", "dy", "oil", "m2", "bus", "vix"]
_WIDE = "SELECT month, " + ", ".join(f"max(value) FILTER (series_id = 'Brand#{i + 1}') AS {n}" for i, n in enumerate(_SHORT)) + """ FROM (SELECT series_id, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(price, date) AS value FROM prices GROUP BY ALL)
    GROUP BY month HAVING count(*) > 0"""
_F = lambda c: f"last_value({c} IGNORE NULLS) OVER (ORDER BY month)"
_FILLED = "SELECT *, m2 / cpi AS m2r, " + ", ".join(f"{_F(c)} AS {c}f" for c in ("cpi", "sp", "oil", "bus")) + f", {_F('m2 / cpi')} AS m2f, CASE WHEN count(un) OVER (ORDER BY month ROWS 2 PRECEDING) = 3 THEN avg(un) OVER (ORDER BY month ROWS 2 PRECEDING) END AS u3 FROM wide"
_Y = lambda c: f"100 * ({c}f / lag({c}f, 12) OVER (ORDER BY month) - 1)"
_R = lambda c, f: f"CASE WHEN count({c}) OVER (ORDER BY month ROWS 11 PRECEDING) = 12 THEN {f}({c}) OVER (ORDER BY month ROWS 11 PRECEDING) END"
_MADE = f"""SELECT month, gs10 - tb3 AS YC_10Y3M, gs10 - gs1 AS YC_10Y1Y, gs5 - tb3 AS YC_5Y3M, gs10 - ff AS YC_10Y_FF, baa - gs10 AS CREDIT_BAA10Y, baa - aaa AS CREDIT_BAA_AAA, aaa - gs10 AS CREDIT_AAA10Y,
    ff - {_Y('cpi')} AS REAL_FF, gs10 - {_Y('cpi')} AS REAL_10Y, u3 - {_R('u3', 'min')} AS SAHM, un - lag(un, 12) OVER (ORDER BY month) AS UNRATE_12M_CHG, {_Y('sp')} AS SPX_MOM12,
    100 * (sp / {_R('sp', 'avg')} - 1) AS SPX_TREND, pe AS SPX_PE, dy AS SPX_DY, 100 / pe - (gs10 - {_Y('cpi')}) AS ERP, {_Y('cpi')} AS "INFL_YoY", {_Y('oil')} AS OIL_MOM12, {_Y('m2')} AS "M2_REAL_YoY", {_Y('bus')} AS CREDIT_GROWTH, vix AS VIX FROM filled"""


def monthly_closes(spark, sf):
    closes = P.keep_last(V.prices(spark, sf).withColumn("month", F.trunc("date", "month")), ["series_id", "month"], ["date"], ["price"])
    return closes.select("series_id", "month", F.col("price").alias("value"))


@query("engineered_features", sql(f"SELECT month, series_id, {r('value', 4)} AS value, CAST(CASE series_id WHEN 'VIX' THEN 4 ELSE 1 END AS BIGINT) AS tcode FROM (UNPIVOT made ON COLUMNS(* EXCLUDE month) INTO NAME series_id VALUE value)",
    "prices", wide=_WIDE, filled=_FILLED, made=_MADE))
def engineered_features(spark, sf):
    return rnd(G.engineered_features(monthly_closes(spark, sf), names=MACRO_NAMES), "value", digits=4)
