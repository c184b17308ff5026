"""Ingest, calendar alignment, filling, filtering and ordered transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import expr as E
from tidepanel.functions import ordered as O
from tidepanel.functions.expr import rounded
from tidepanel.operators import panel as P
from tidepanel.operators import sequences as Q
from tidepanel.plans import views as V
from tidepanel.plans.oracle_views import r, sql
from tidepanel.plans.registry import query
from tidepanel.sources import shaping as H

KEY = ["series_id"]
W = "(PARTITION BY series_id ORDER BY date)"


def rnd(df, *names, digits=6):
    return df.select(*[rounded(c, digits).alias(c) if c in names else c for c in df.columns])


# ---- ingest --------------------------------------------------------------------------------

@query("dedupe_keep_last", sql("""SELECT series_id, date, price FROM prices_raw
    QUALIFY row_number() OVER (PARTITION BY series_id, date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) = 1""", "prices_raw"))
def dedupe_keep_last(spark, sf):
    return P.keep_last(V.prices_raw(spark, sf), ["series_id", "date"], V.SEQUENCE, ["price"])


@query("coverage_report", sql("""SELECT series_id, count(*) AS n_obs, min(date) AS first_date, max(date) AS last_date
    FROM prices GROUP BY ALL""", "prices"))
def coverage_report(spark, sf):
    return P.coverage(V.prices(spark, sf))


@query("mixed_date_parse", """SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY ALL""")
def mixed_date_parse(spark, sf):
    """Odd orders carry their date as a spreadsheet serial number, even ones as text."""
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    text = F.when(F.col("o_orderkey") % 2 == 1, serial).otherwise(F.date_format(day, "yyyy-MM-dd"))
    return V.table(spark, sf, "orders").select(E.parse_mixed_date(text).alias("date")).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("compact_dates_percent", f"""SELECT CAST(l_shipdate AS DATE) AS date, last_day(CAST(l_shipdate AS DATE)) AS month_end, count(*) AS n,
    {r('sum(l_discount) / 100')} AS decimal_sum FROM lineitem GROUP BY ALL""")
def compact_dates_percent(spark, sf):
    """``yyyymmdd`` and ``yyyymm`` integers and percent values, as factor files store them."""
    line = V.table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyyMMdd").alias("d"), F.date_format("l_shipdate", "yyyyMM").alias("m"), "l_discount")
    line = line.select(E.parse_compact_day("d").alias("date"), E.parse_compact_month_end("m").alias("month_end"), "l_discount")
    return line.groupBy("date", "month_end").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_discount") / 100).alias("decimal_sum"))


@query("coerce_to_long", f"""SELECT date, name AS series_id, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (
    SELECT CAST(ts AS DATE) AS date, {r('avg(value)', 4)} AS mean_value, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL)
    ON mean_value, n INTO NAME name VALUE value)""")
def coerce_to_long(spark, sf):
    """A wide text panel: every column cast where possible, then long."""
    wide = V.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(
        rounded(F.avg("value"), 4).cast("string").alias("mean_value"), F.count(F.lit(1)).cast("string").alias("n"))
    wide = wide.withColumn("note", F.lit("n/a"))
    return H.to_long(wide, ["date"], ["mean_value", "n", "note"])


@query("transform_code_row", sql("SELECT month, series_id, value, tcode FROM macro_monthly", "macro_monthly"))
def transform_code_row(spark, sf):
    """A wide file whose first data row holds the codes, split into codes and long data."""
    macro = V.macro_monthly(spark, sf)
    names = list(V.MACRO_CODES)
    wide = macro.groupBy(F.date_format("month", "yyyy-MM-dd").alias("sasdate")).pivot("series_id", names).agg(F.max(F.col("value").cast("string")))
    codes = macro.groupBy(F.lit("Transform:").alias("sasdate")).pivot("series_id", names).agg(F.max(F.col("tcode").cast("string")))
    data, tcodes = H.split_code_row(codes.unionByName(wide), "sasdate")
    return data.join(tcodes, "series_id").select(F.col("date").alias("month"), "series_id", "value", F.col("tcode").cast("long").alias("tcode"))


@query("prefix_exclude_codes", sql("""SELECT p_type AS series_id, CASE p_type WHEN 'STANDARD' THEN 5 ELSE 1 END AS tcode, count(*) AS n
    FROM part WHERE NOT starts_with(p_type, 'ECO') GROUP BY ALL"""))
def prefix_exclude_codes(spark, sf):
    part = V.table(spark, sf, "part").select(F.col("p_type").alias("series_id"))
    kept = H.with_codes(part.where(~F.startswith("series_id", F.lit("ECO"))), {"STANDARD": 5}, default=1)
    return kept.groupBy("series_id", "tcode").agg(F.count(F.lit(1)).alias("n"))


@query("name_map_keep", sql(f"""SELECT m.name AS series_id, date, {r('price')} AS price FROM prices JOIN (VALUES {', '.join(f"('Brand#{i}', 'B{i:02d}')" for i in range(1, 21))})
    m(raw, name) ON m.raw = series_id""", "prices"))
def name_map_keep(spark, sf):
    """Provider names become short ones, unknown series drop out."""
    return rnd(H.rename_known(V.prices(spark, sf), {f"Brand#{i}": f"B{i:02d}" for i in range(1, 21)}), "price").select("series_id", "date", "price")


@query("pre_daily_cutoff", sql(f"""SELECT series_id, count(*) AS n, min(date) AS first_date FROM prices
    WHERE date >= CASE WHEN series_id IN ('Brand#3', 'Brand#7') THEN DATE '1997-06-02' ELSE date END GROUP BY ALL""", "prices"))
def pre_daily_cutoff(spark, sf):
    tagged = H.with_daily_from(V.prices(spark, sf), {"Brand#3": "1997-06-02", "Brand#7": "1997-06-02"})
    kept = tagged.where(F.col("date") >= F.coalesce("daily_from", "date"))
    return kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


@query("flag_load", sql("SELECT month, flag FROM flag_monthly", "flag_monthly"))
def flag_load(spark, sf):
    text = V.flag_monthly(spark, sf).select(F.date_format("month", "yyyy-MM-dd").alias("observation_date"), F.col("flag").cast("string").alias("USREC"))
    return H.parse_flag(text, "observation_date", "USREC")


# ---- calendar and filling ----------------------------------------------------------------------

@query("business_calendar", sql("SELECT series_id, date FROM grid", "grid"))
def business_calendar(spark, sf):
    return P.business_calendar(V.prices(spark, sf), KEY, V.START, V.END)


@query("calendar_reindex", sql(f"SELECT series_id, date, {r('price')} AS price FROM reindexed", "reindexed"))
def calendar_reindex(spark, sf):
    return rnd(P.align_to_calendar(V.prices(spark, sf), KEY, "price", V.START, V.END, limit=0), "price")


@query("ffill_limit", sql(f"SELECT series_id, date, {r('price')} AS price FROM dense_prices", "dense_prices"))
def ffill_limit(spark, sf):
    return rnd(V.dense_prices(spark, sf), "price")


@query("ffill_window_limit", sql(f"""SELECT series_id, date, {r(f'last_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS price
    FROM reindexed""", "reindexed"))
def ffill_window_limit(spark, sf):
    """The window form of the limited fill, for panels that already lie on a calendar."""
    panel = O.with_position(P.align_to_calendar(V.prices(spark, sf), KEY, "price", V.START, V.END, limit=0), KEY)
    return rnd(panel.withColumn("price", O.forward_fill("price", O.by(KEY), 3, "position")).drop("position"), "price")


@query("backfill", sql(f"""SELECT series_id, date, {r(f'first_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS price
    FROM reindexed""", "reindexed"))
def backfill(spark, sf):
    panel = P.align_to_calendar(V.prices(spark, sf), KEY, "price", V.START, V.END, limit=0)
    return rnd(panel.withColumn("price", O.backward_fill("price", KEY)), "price")


_DAILY_FROM = {"Brand#2": "1996-04-03", "Brand#5": "1998-01-01", "Brand#11": "1995-06-05"}
_SPLIT = " ".join(f"WHEN '{k}' THEN DATE '{v}'" for k, v in _DAILY_FROM.items())


@query("mixed_frequency_align", sql(f"""SELECT series_id, date, {r('''CASE WHEN daily
      THEN last_value(price IGNORE NULLS) OVER (PARTITION BY series_id, daily ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
      ELSE last_value(price IGNORE NULLS) OVER (PARTITION BY series_id, daily ORDER BY date ROWS BETWEEN 35 PRECEDING AND CURRENT ROW) END''')} AS price
    FROM (SELECT *, coalesce(date >= CASE series_id {_SPLIT} END, true) AS daily FROM grid LEFT JOIN monthly USING (series_id, date))""", "prices", "grid",
    monthly=f"""SELECT series_id, date, price FROM prices WHERE date >= coalesce(CASE series_id {_SPLIT} END, date)
      OR date = (SELECT max(date) FROM prices p WHERE p.series_id = prices.series_id AND date_trunc('month', p.date) = date_trunc('month', prices.date))"""))
def mixed_frequency_align(spark, sf):
    """Three series keep only one price a month before their daily history starts."""
    tagged = H.with_daily_from(V.prices(spark, sf), _DAILY_FROM)
    month_last = F.max("date").over(O.Window.partitionBy("series_id", F.trunc("date", "month")))
    thin = tagged.withColumn("_last", month_last).where((F.col("date") >= F.coalesce("daily_from", "date")) | (F.col("date") == F.col("_last")))
    out = P.align_to_calendar(thin, KEY, "price", V.START, V.END, daily_from="daily_from")
    return rnd(out.select("series_id", "date", "price"), "price")


_FLAT = f"SELECT series_id, date, floor(price / 200) * 200 AS price FROM dense_prices"


@query("stale_to_null", sql(f"""SELECT series_id, date, last_value(fresh IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS price
    FROM (SELECT *, CASE WHEN price = lag(price) OVER {W} THEN NULL ELSE price END AS fresh FROM flat)""", "dense_prices", flat=_FLAT))
def stale_to_null(spark, sf):
    flat = V.dense_prices(spark, sf).withColumn("price", (F.floor(F.col("price") / 200) * 200).cast("double"))
    return P.strip_stale(flat, KEY, "price")


@query("asof_reindex", sql(f"""SELECT g.series_id, g.date, {r('p.price')} AS price FROM grid g ASOF LEFT JOIN prices p
    ON g.series_id = p.series_id AND g.date >= p.date""", "grid"))
def asof_reindex(spark, sf):
    prices = V.prices(spark, sf)
    return rnd(P.as_of(P.business_calendar(prices, KEY, V.START, V.END), prices, KEY, ["price"]), "price")


@query("date_intersection", """SELECT CAST(o_orderdate AS DATE) AS date FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem""")
def date_intersection(spark, sf):
    a = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    b = V.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return a.intersect(b)


@query("missing_keys", """SELECT month, asset FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders),
    (SELECT DISTINCT o_orderpriority AS asset FROM orders) EXCEPT SELECT CAST(date_trunc('month', o_orderdate) AS DATE), o_orderpriority FROM orders WHERE o_totalprice > 400000""")
def missing_keys(spark, sf):
    """Expected (month, asset) keys without a large order."""
    orders = V.table(spark, sf, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("month"), F.col("o_orderpriority").alias("asset"), "o_totalprice")
    names = F.array(*[F.lit(n) for n in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    expected = orders.select("month").distinct().select("month", F.explode(names).alias("asset"))
    present = orders.where(F.col("o_totalprice") > 400000).select("month", "asset").distinct()
    return expected.join(present, ["month", "asset"], "left_anti")


@query("outer_concat", sql(f"""SELECT NULL AS universe, series_id, date, {r('price', 4)} AS value FROM prices UNION ALL
    SELECT universe, asset, month, {r('ret')} FROM asset_returns""", "prices", "asset_returns"))
def outer_concat(spark, sf):
    """Prices belong to no universe."""
    a = V.prices(spark, sf).select(F.lit(None).cast("string").alias("universe"), "series_id", "date", rounded("price", 4).alias("value"))
    b = V.asset_returns(spark, sf)
    return a.unionByName(b.select("universe", F.col("asset").alias("series_id"), F.col("month").alias("date"), rounded("ret").alias("value")))


@query("walk_forward_splits", sql("""SELECT entity, CAST(d AS DATE) AS refit_date, CAST(d - INTERVAL 5 YEAR AS DATE) AS train_from, CAST(d + INTERVAL 3 MONTH AS DATE) AS test_to
    FROM (SELECT entity, unnest(generate_series(lo + INTERVAL 5 YEAR, CAST(hi AS TIMESTAMP), INTERVAL 3 MONTH)) AS d FROM (
    SELECT series_id AS entity, min(date) AS lo, max(date) AS hi FROM prices GROUP BY ALL))""", "prices"))
def walk_forward_splits(spark, sf):
    return H.walk_forward(V.prices(spark, sf).withColumnRenamed("series_id", "entity"), ["entity"], train_years=5, step_months=3)


@query("parameter_grid", sql(f"""SELECT universe, asset, gamma, {r('gamma * avg(ret)')} AS value FROM asset_returns, (VALUES (0.02::DOUBLE), (0.04), (0.06), (0.08), (0.1)) g(gamma) GROUP BY universe, asset, gamma""", "asset_returns"))
def parameter_grid(spark, sf):
    grid = F.explode(F.array(*[F.lit(g) for g in (0.02, 0.04, 0.06, 0.08, 0.1)])).alias("gamma")
    means = V.asset_returns(spark, sf).groupBy("universe", "asset").agg(F.avg("ret").alias("m"))
    return means.select("universe", "asset", grid, "m").select("universe", "asset", "gamma", rounded(F.col("gamma") * F.col("m")).alias("value"))


# ---- ordered transforms -----------------------------------------------------------------------

@query("log_returns", sql(f"SELECT series_id, date, {r('ret')} AS ret FROM returns", "returns"))
def log_returns(spark, sf):
    return rnd(V.returns(spark, sf), "ret")


@query("return_panel", sql(f"""SELECT series_id, date, {r('ret')} AS ret FROM returns WHERE date > (SELECT min(date) FROM returns)
    AND date IN (SELECT date FROM returns WHERE ret IS NOT NULL)""", "returns"))
def return_panel(spark, sf):
    panel = V.returns(spark, sf).where(F.col("date") > F.lit(V.START).cast("date"))
    return rnd(P.drop_empty_dates(panel, "ret"), "ret").select("series_id", "date", "ret")


_MW = "(PARTITION BY series_id ORDER BY month)"
_L = {k: f"lag(v, {k}) OVER {_MW}" for k in (1, 2)}


@query("tcode_transform", sql(f"""SELECT month, series_id, tcode, {r(f'''CASE tcode WHEN 1 THEN v WHEN 2 THEN v - {_L[1]} WHEN 3 THEN (v - {_L[1]}) - ({_L[1]} - {_L[2]})
    WHEN 4 THEN ln(v) WHEN 5 THEN ln(v) - ln({_L[1]}) WHEN 6 THEN (ln(v) - ln({_L[1]})) - (ln({_L[1]}) - ln({_L[2]}))
    WHEN 7 THEN (v / {_L[1]} - 1) - ({_L[1]} / {_L[2]} - 1) END''', 4)} AS value FROM (SELECT *, value AS v FROM macro_monthly)""", "macro_monthly"))
def tcode_transform(spark, sf):
    macro = V.macro_monthly(spark, sf)
    return rnd(macro.withColumn("value", O.transform_by_code("value", "tcode", O.by(KEY, "month"))), "value", digits=4)


@query("pct_change_12", sql(f"""SELECT month, series_id, {r('f / lag(f, 12) OVER ' + _MW + ' - 1')} AS value FROM (SELECT month, series_id,
    last_value(v IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY month) AS f FROM holed)""", "macro_monthly",
    holed="SELECT month, series_id, CASE WHEN month(month) <> 5 THEN value END AS v FROM macro_monthly"))
def pct_change_12(spark, sf):
    holed = V.macro_monthly(spark, sf).withColumn("value", F.when(F.month("month") != 5, F.col("value")))
    return rnd(holed.select("month", "series_id", O.percent_change("value", O.by(KEY, "month"), 12).alias("value")), "value")


@query("spread_features", sql(f"""SELECT month, {r("max(value) FILTER (series_id = 'A|F') - max(value) FILTER (series_id = 'R|F')", 2)} AS difference,
    {r("max(value) FILTER (series_id = 'A|F') / max(value) FILTER (series_id = 'R|F')")} AS quotient FROM macro_monthly GROUP BY ALL
    HAVING count(*) FILTER (series_id IN ('A|F', 'R|F')) > 0""", "macro_monthly"))
def spread_features(spark, sf):
    macro = V.macro_monthly(spark, sf)
    a = P.spread(macro, "A|F", "R|F", "d", date="month").select("month", rounded("value", 2).alias("difference"))
    b = P.spread(macro, "A|F", "R|F", "q", how="ratio", date="month").select("month", rounded("value").alias("quotient"))
    return a.join(b, "month")


@query("quote_flip", sql(f"""SELECT series_id, date, {r("CASE WHEN series_id IN ('Brand#2', 'Brand#4', 'Brand#8') THEN -ret ELSE ret END")} AS ret FROM returns WHERE ret IS NOT NULL""", "returns"))
def quote_flip(spark, sf):
    return rnd(H.flip_quotes(V.returns(spark, sf).where("ret IS NOT NULL"), ["Brand#2", "Brand#4", "Brand#8"]), "ret")


@query("rate_conversion", sql(f"""SELECT month, series_id, {r('pow(1 + rate / 100, 1.0 / 252) - 1', 9)} AS daily, {r('(pow(1 + rate / 1000, 4) - 1) * 100')} AS annual
    FROM (SELECT month, series_id, value / 1000000 AS rate FROM macro_monthly)""", "macro_monthly"))
def rate_conversion(spark, sf):
    rates = V.macro_monthly(spark, sf).withColumn("rate", F.col("value") / 1000000)
    return rates.select("month", "series_id", rounded(E.annual_percent_to_daily("rate"), 9).alias("daily"),
                        rounded(E.quarterly_to_annual_percent(F.col("rate") / 1000)).alias("annual"))


@query("priority_coalesce", sql(f"""SELECT date, arg_min(series_id, k) AS series_id, {r('arg_min(price, k)')} AS price FROM (SELECT *, CASE series_id
    WHEN 'Brand#9' THEN 1 WHEN 'Brand#1' THEN 2 WHEN 'Brand#25' THEN 3 END AS k FROM reindexed WHERE price IS NOT NULL) WHERE k IS NOT NULL GROUP BY ALL""", "reindexed"))
def priority_coalesce(spark, sf):
    panel = V.prices(spark, sf).where(E.is_business_day("date") & F.col("date").between(V.START, V.END))
    return rnd(P.coalesce_sources(panel, ["date"], "series_id", "price", ["Brand#9", "Brand#1", "Brand#25"]), "price")


@query("series_fallback", sql(f"""SELECT 'equity' AS role, date, {r('price')} AS price FROM prices WHERE series_id = 'Brand#2' UNION ALL
    SELECT 'rates', date, {r('price')} FROM prices WHERE series_id = 'Brand#4'""", "prices"))
def series_fallback(spark, sf):
    chosen = P.first_available(V.prices(spark, sf), {"equity": ["Brand#99", "Brand#2", "Brand#3"], "rates": ["Brand#4", "Brand#5"]})
    return rnd(chosen.select("role", "date", "price"), "price")


@query("null_fraction_filter", sql(f"""SELECT series_id, date, {r('ret')} AS ret FROM returns WHERE date IN (SELECT date FROM returns GROUP BY date
    HAVING 25 - count(ret) <= CAST(floor(0.1 * 25) AS INT))""", "returns"))
def null_fraction_filter(spark, sf):
    return rnd(P.null_fraction_rows(V.returns(spark, sf), 0.1, 25, value="ret"), "ret").select("series_id", "date", "ret")


@query("complete_rows", sql(f"""SELECT series_id, date, {r('ret')} AS ret FROM returns WHERE series_id IN ('Brand#1', 'Brand#2', 'Brand#3') AND date IN (
    SELECT date FROM returns WHERE series_id IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY date HAVING count(ret) = 3)""", "returns"))
def complete_rows(spark, sf):
    names = ["Brand#1", "Brand#2", "Brand#3"]
    return rnd(P.complete_groups(V.returns(spark, sf).where(F.col("series_id").isin(names)), ["date"], "ret", len(names)), "ret").select("series_id", "date", "ret")


@query("sparse_series_drop", sql(f"""SELECT series_id, count(*) AS n, count(price) AS known FROM reindexed GROUP BY ALL
    HAVING count(price) >= floor(0.55 * count(*))""", "reindexed"))
def sparse_series_drop(spark, sf):
    panel = P.align_to_calendar(V.prices(spark, sf), KEY, "price", V.START, V.END, limit=0)
    days = F.lit(sum(1 for _ in _business_days(V.START, V.END)))
    kept = P.drop_sparse_series(panel, KEY, "price", days, 0.55)
    return kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("known"))


def _business_days(start, end):
    import datetime

    day, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    while day <= last:
        if day.weekday() < 5:
            yield day
        day += datetime.timedelta(days=1)


@query("exclude_series", sql(f"""SELECT series_id, count(*) AS n, {r('avg(price)', 4)} AS mean FROM prices WHERE series_id NOT IN ('Brand#5', 'Brand#6') GROUP BY ALL""", "prices"))
def exclude_series(spark, sf):
    kept = H.exclude(V.prices(spark, sf), ["Brand#5", "Brand#6"])
    return kept.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("price"), 4).alias("mean"))


@query("date_math", """SELECT CAST(o_orderdate AS DATE) AS date, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, last_day(CAST(o_orderdate AS DATE)) AS month_end,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) AS next_year, strftime(o_orderdate, '%Y-%m-%d') AS text, count(*) AS n FROM orders GROUP BY ALL""")
def date_math(spark, sf):
    d = F.col("date")
    orders = V.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return orders.groupBy("date").agg(F.count(F.lit(1)).alias("n")).select(
        "date", E.month_start(d).alias("month"), F.last_day(d).alias("month_end"), F.add_months(d, 12).alias("next_year"), F.date_format(d, "yyyy-MM-dd").alias("text"), "n")


@query("math_scalars", f"""SELECT o_orderkey, {r('ln(o_totalprice)')} AS ln, {r('log2(o_totalprice)')} AS log2, {r('exp(-o_totalprice / 1e6)')} AS e, {r('sqrt(o_totalprice)')} AS root,
    {r('pow(o_totalprice / 1e5, 1.5)')} AS p, abs(o_totalprice - 2e5) AS a, sign(o_totalprice - 2e5)::DOUBLE AS s, least(greatest(o_totalprice, 1e5), 3e5) AS clip FROM orders""")
def math_scalars(spark, sf):
    v = F.col("o_totalprice")
    return V.table(spark, sf, "orders").select(
        "o_orderkey", rounded(E.safe_log(v)).alias("ln"), rounded(F.log2(v)).alias("log2"), rounded(F.exp(-v / 1e6)).alias("e"), rounded(F.sqrt(v)).alias("root"),
        rounded(F.pow(v / 1e5, F.lit(1.5))).alias("p"), F.abs(v - 2e5).alias("a"), F.signum(v - 2e5).alias("s"), F.least(F.greatest(v, F.lit(1e5)), F.lit(3e5)).alias("clip"))


@query("string_scalars", """SELECT p_brand, starts_with(p_brand, 'Brand#1') AS pre, split_part(p_brand, '#', 2) AS tail, replace(p_brand, 'Brand#', 'p_state') AS renamed,
    regexp_matches(p_brand, '[12]$') AS hit, count(*) AS n FROM part GROUP BY ALL""")
def string_scalars(spark, sf):
    b = F.col("p_brand")
    return V.table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).select(
        "p_brand", F.startswith(b, F.lit("Brand#1")).alias("pre"), F.split(b, "#")[1].alias("tail"), F.regexp_replace(b, "Brand#", "p_state").alias("renamed"), b.rlike("[12]$").alias("hit"), "n")


@query("null_handling", sql(f"""SELECT series_id, date, coalesce({r('price')}, -1) AS constant, {r('coalesce(price, median(price) OVER (PARTITION BY series_id))')} AS filled,
    {r('CASE WHEN price < 1000 THEN price END')} AS masked FROM reindexed""", "reindexed"))
def null_handling(spark, sf):
    panel = P.align_to_calendar(V.prices(spark, sf), KEY, "price", V.START, V.END, limit=0)
    median = F.percentile("price", F.lit(0.5)).over(O.Window.partitionBy("series_id"))
    return panel.select("series_id", "date", F.coalesce(rounded("price"), F.lit(-1.0)).alias("constant"), rounded(F.coalesce("price", median)).alias("filled"),
                        rounded(F.when(F.col("price") < 1000, F.col("price"))).alias("masked"))


@query("lookup_default", sql("""SELECT seq_id, event_id, CASE state WHEN 0 THEN 'Calm' WHEN 2 THEN 'Crisis' ELSE 'Regime_' || state END AS regime FROM states""", "states"))
def lookup_default(spark, sf):
    return H.name_states(V.states(spark, sf), {0: "Calm", 2: "Crisis"}, "state", "regime").select("seq_id", "event_id", "regime")


@query("array_ops", sql(f"""SELECT row_id, {r('list_dot_product(x, x)')} AS square, {r('sqrt(list_dot_product(x, x))')} AS norm, CAST(list_position(x, list_max(x)) - 1 AS BIGINT) AS top,
    CAST(list_position(x, list_min(x)) - 1 AS BIGINT) AS bottom FROM features""", "features"))
def array_ops(spark, sf):
    return V.features(spark, sf).select("row_id", rounded(E.dot("x", "x")).alias("square"), rounded(E.l2_norm("x")).alias("norm"), E.argmax("x").alias("top"), E.argmin("x").alias("bottom"))


@query("outer_product", sql(f"""SELECT a.month, a.series_id AS i, b.series_id AS j, {r('a.value / 1e6 * b.value / 1e6')} AS v FROM macro_monthly a JOIN macro_monthly b USING (month)""", "macro_monthly"))
def outer_product(spark, sf):
    """All products of one month's seven values, from arrays of fixed length."""
    rows = V.macro_monthly(spark, sf).groupBy("month").agg(F.array_sort(F.array_agg(F.struct("series_id", (F.col("value") / 1e6).alias("v")))).alias("c"))
    rows = rows.select("month", "c", F.explode("c").alias("a")).select("month", "a", F.explode("c").alias("b"))
    return rows.select("month", F.col("a.series_id").alias("i"), F.col("b.series_id").alias("j"), rounded(F.col("a.v") * F.col("b.v")).alias("v"))


# ---- windows -----------------------------------------------------------------------------------

@query("lag_differences", sql(f"""SELECT series_id, date, {r(f'price - lag(price) OVER {W}')} AS d1, {r(f'price - lag(price, 12) OVER {W}')} AS d12 FROM dense_prices""", "dense_prices"))
def lag_differences(spark, sf):
    w = O.by(KEY)
    return V.dense_prices(spark, sf).select("series_id", "date", rounded(F.col("price") - F.lag("price").over(w)).alias("d1"), rounded(F.col("price") - F.lag("price", 12).over(w)).alias("d12"))


_R12 = "(PARTITION BY series_id ORDER BY date ROWS 11 PRECEDING)"


@query("rolling_stats", sql(f"""SELECT series_id, date, {', '.join(f"{r(f'CASE WHEN count(price) OVER {_R12} = 12 THEN {f}(price) OVER {_R12} END', 4)} AS {n}" for n, f in
    (('mean', 'avg'), ('low', 'min'), ('total', 'sum'), ('std', 'stddev_samp')))} FROM dense_prices""", "dense_prices"))
def rolling_stats(spark, sf):
    w = O.by(KEY)
    return V.dense_prices(spark, sf).select("series_id", "date", *[rounded(O.rolling("price", w, 12, how), 4).alias(n) for n, how in (("mean", "mean"), ("low", "min"), ("total", "sum"), ("std", "std"))])


_R252 = "(PARTITION BY series_id ORDER BY date ROWS 251 PRECEDING)"


@query("rolling_vol_momentum", sql(f"""SELECT series_id, date, {r(f'CASE WHEN count(ret) OVER {_R252} >= 126 THEN stddev_samp(ret) OVER {_R252} END')} AS vol,
    {r(f'CASE WHEN count(ret) OVER {_R252} >= 126 THEN sum(ret) OVER {_R252} END')} AS momentum FROM returns""", "returns"))
def rolling_vol_momentum(spark, sf):
    out = O.with_long_rolling(V.returns(spark, sf), KEY, "ret", 252, 126, total="momentum", std="vol")
    return rnd(out.select("series_id", "date", "vol", "momentum"), "vol", "momentum")


@query("rank_avg_ties", sql(f"""SELECT series_id, n, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE AS rank
    FROM (SELECT p_brand AS series_id, count(*) // 10 AS n FROM part GROUP BY ALL)"""))
def rank_avg_ties(spark, sf):
    counts = V.table(spark, sf, "part").groupBy(F.col("p_brand").alias("series_id")).agg(F.floor(F.count(F.lit(1)) / 10).alias("n"))
    return counts.select("series_id", "n", O.average_rank("n", []).alias("rank"))


@query("hold_month_end", sql(f"""SELECT p.series_id, p.date, {r('c.price')} AS price FROM dense_prices p LEFT JOIN (SELECT series_id, last_day(date) AS stamp, arg_max(price, date) AS price
    FROM dense_prices WHERE price IS NOT NULL GROUP BY ALL) c ON c.series_id = p.series_id
    AND c.stamp = CASE WHEN p.date = last_day(p.date) THEN p.date ELSE last_day(CAST(p.date - INTERVAL 1 MONTH AS DATE)) END""", "dense_prices"))
def hold_month_end(spark, sf):
    return rnd(P.month_end_hold(V.dense_prices(spark, sf), KEY, "price"), "price")


_POS = f"SELECT series_id, date, price, row_number() OVER {W} AS n FROM reindexed"
_SIDES = f"""SELECT *, last_value(CASE WHEN price IS NOT NULL THEN n END IGNORE NULLS) OVER {W} AS ln, last_value(price IGNORE NULLS) OVER {W} AS lv,
    first_value(CASE WHEN price IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rn,
    first_value(price IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv FROM pos"""


@query("interpolate_linear", sql(f"""SELECT series_id, date, {r('CASE WHEN price IS NOT NULL THEN price WHEN ln IS NULL THEN rv WHEN rn IS NULL THEN lv ELSE lv + (rv - lv) * (n - ln) / (rn - ln) END')} AS price
    FROM sides""", "reindexed", pos=_POS, sides=_SIDES))
def interpolate_linear(spark, sf):
    panel = O.with_position(P.align_to_calendar(V.prices(spark, sf), KEY, "price", V.START, V.END, limit=0), KEY)
    return rnd(panel.withColumn("price", O.interpolated("price", KEY)).drop("position"), "price")


@query("tail_rows", sql(f"""SELECT series_id, date, {r('price')} AS price FROM dense_prices QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 60""", "dense_prices"))
def tail_rows(spark, sf):
    return rnd(P.tail_rows(V.dense_prices(spark, sf), KEY, 60), "price")


@query("sort_nulls_last", sql(f"""SELECT * FROM (SELECT series_id, date, {r('ret')} AS ret FROM returns ORDER BY ret ASC NULLS LAST, series_id, date LIMIT 20)""", "returns"))
def sort_nulls_last(spark, sf):
    """A top-k report: the 20 lowest returns, missing ones last."""
    return rnd(V.returns(spark, sf), "ret").orderBy(F.col("ret").asc_nulls_last(), "series_id", "date").limit(20)


# ---- event sequences -----------------------------------------------------------------------------



@query("previous_state", sql("SELECT seq_id, event_id, state, lag(state) OVER (PARTITION BY seq_id ORDER BY ts, event_id) AS prev_state FROM states", "states"))
def previous_state(spark, sf):
    out = Q.with_neighbour(Q.with_block(V.states(spark, sf), ["seq_id"], ["ts", "event_id"]), ["seq_id"], ["ts", "event_id"], "state", "prev_state")
    return out.select("seq_id", "event_id", "state", "prev_state")


_PAIRS = "SELECT state, lead(state) OVER (PARTITION BY seq_id ORDER BY ts, event_id) AS nxt FROM states"


@query("transition_matrix", sql(f"""SELECT CAST(f AS BIGINT) AS from_state, CAST(t AS BIGINT) AS to_state, coalesce(n, 0) AS n,
    {r('coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY f), 0), 0)')} AS p FROM range(5) a(f) CROSS JOIN range(5) b(t)
    LEFT JOIN (SELECT state, nxt, count(*) AS n FROM pairs WHERE nxt IS NOT NULL GROUP BY ALL) c ON c.state = f AND c.nxt = t""", "states", pairs=_PAIRS))
def transition_matrix(spark, sf):
    from tidepanel.operators import regimes as G

    counts = Q.transition_counts(V.states(spark, sf), ["seq_id"], ["ts", "event_id"], "state")
    return rnd(G.transition_matrix(counts, 5), "p")


@query("regime_periods", sql("""SELECT seq_id, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY run) AS BIGINT) AS run_id, state, start, coalesce(lead(start) OVER (PARTITION BY seq_id ORDER BY run), last_time) AS "end", last_time, n_rows
    FROM (SELECT seq_id, run, first(state) AS state, min(ts) AS start, max(ts) AS last_time, count(*) AS n_rows FROM (
    SELECT *, sum(change) OVER (PARTITION BY seq_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY seq_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS change FROM states)) GROUP BY ALL)""", "states"))
def regime_periods(spark, sf):
    return Q.periods(V.states(spark, sf), ["seq_id"], ["ts", "event_id"], "state", "ts")


@query("month_last_state", sql("""SELECT seq_id, CAST(date_trunc('month', ts) AS DATE) AS month, arg_max(state, (ts, event_id)) AS state FROM states GROUP BY ALL""", "states"))
def month_last_state(spark, sf):
    return Q.last_per_period(V.states(spark, sf), ["seq_id"], F.trunc(F.to_date("ts"), "month"), ["ts", "event_id"], ["state"])
