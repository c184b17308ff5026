"""Panels derived from the driver's tables; ``oracle_views`` states the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.functions import ordered as O
from tidepanel.functions.expr import from_names
from tidepanel.operators import panel as P

# Calendar span of the tables and the event types in alphabetical order.
START, END = "1995-01-02", "2001-12-31"
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series_id"))
    return line.join(part, line.l_partkey == part.p_partkey).select(
        "series_id",
        F.to_date("l_shipdate").alias("date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def cents(c: str):
    """Amounts as whole cents: their sums do not depend on the order of addition."""
    return F.round(F.col(c) * 100).cast("long")


SEQUENCE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily price per brand: turnover over quantity."""
    price = F.sum(cents("l_extendedprice")) / (100.0 * F.sum("l_quantity"))
    return prices_raw(spark, sf_dir).groupBy("series_id", "date").agg(price.alias("price"))


def dense_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.align_to_calendar(prices(spark, sf_dir), ["series_id"], "price", START, END)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.log_returns(dense_prices(spark, sf_dir)).select("series_id", "date", "ret")


def asset_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns per universe (order status) and asset (priority); NULL next to a missing month."""
    monthly = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("universe"),
        F.col("o_orderpriority").alias("asset"),
        F.trunc(F.to_date("o_orderdate"), "month").alias("month"),
    ).agg((F.sum(cents("o_totalprice")) / 100.0).alias("v"))
    w = O.by(["universe", "asset"], "month")
    adjacent = F.lag("month").over(w) == F.add_months("month", -1)
    return monthly.select("universe", "asset", "month", F.when(adjacent, F.col("v") / F.lag("v").over(w) - 1).alias("ret")).where(
        F.col("ret").isNotNull()
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("seq_id"), "ts", "event_id", from_names(EVENT_TYPES, "event_type").cast("long").alias("state")
    )


def states_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per universe and month, the number of the priority with the highest revenue."""
    sums = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("universe"),
        F.trunc(F.to_date("o_orderdate"), "month").alias("month"),
        (F.substring("o_orderpriority", 1, 1).cast("long") - 1).alias("state"),
    ).agg(F.sum(cents("o_totalprice")).alias("v"))
    best = F.min_by("state", F.struct(-F.col("v"), F.col("state")))
    return sums.groupBy("universe", "month").agg(best.alias("state"))


def flag_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 in months whose share of finished orders lies above the median month."""
    share = table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("share")
    )
    median = F.percentile("share", F.lit(0.5)).over(Window.partitionBy())
    return share.select("month", F.when(F.col("share") > median, 1).otherwise(0).cast("long").alias("flag"))


# The seven monthly series and their transform codes.
MACRO_CODES = {"A|F": 1, "A|O": 2, "N|F": 3, "N|O": 4, "R|F": 5, "R|O": 6, "TOTAL": 7}


def macro_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    code = F.create_map(*[F.lit(v) for kv in MACRO_CODES.items() for v in kv])
    names = F.array(F.concat_ws("|", "l_returnflag", "l_linestatus"), F.lit("TOTAL"))
    sums = line.groupBy(F.trunc(F.to_date("l_shipdate"), "month").alias("month"), "l_returnflag", "l_linestatus").agg(
        F.sum(cents("l_extendedprice")).alias("v")
    )
    long = sums.select("month", F.explode(names).alias("series_id"), "v")
    out = long.groupBy("month", "series_id").agg(F.floor(F.sum("v") / 100.0).cast("double").alias("value"))
    return out.withColumn("tcode", code[F.col("series_id")].cast("long"))


def annual_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    # fold orders by customer and year before any join: one row per customer-year travels
    folded = orders.groupBy("o_custkey", F.year("o_orderdate").cast("long").alias("year")).agg(F.sum(cents("o_totalprice")).alias("v"))
    return (
        folded.join(customer, folded.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey", "year").agg(F.sum("v").alias("v"))
        .join(nation, F.col("c_nationkey") == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == region.r_regionkey)
        .select("year", F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation"), F.col("r_name").alias("bloc"), (F.col("v") / 100.0).alias("gdp"))
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label")
    )


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("row_id", "label", F.posexplode("x").alias("feature", "value")).withColumn(
        "feature", F.col("feature").cast("long")
    )


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"), (F.sum(cents("value")) / (100.0 * F.count("value"))).alias("mean_value")
    )


# Three portfolios over the assets in alphabetical order, and two penalty levels.
PORTFOLIOS = {"FIRST": [0.6, 0.1, 0.1, 0.1, 0.1], "EVEN": [0.2, 0.2, 0.2, 0.2, 0.2], "LAST": [0.0, 0.1, 0.2, 0.3, 0.4]}
GAMMAS = [0.02, 0.10]


def backtest_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of fixed portfolios per universe, month and penalty level, with the previous month's state."""
    from tidepanel.operators.risk import return_matrix

    matrix = return_matrix(asset_returns(spark, sf_dir), ["universe"])
    state = states_monthly(spark, sf_dir)
    w = O.by(["universe"], "month")
    state = state.select("universe", "month", F.lag("state").over(w).alias("prev_state"))
    books = F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.lit(g).alias("gamma"), F.array(*[F.lit(x) for x in ws]).alias("w"))
        for s, ws in PORTFOLIOS.items() for g in GAMMAS
    ])
    dotted = F.aggregate(F.zip_with("r", "b.w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = matrix.select("universe", "month", "r", F.explode(books).alias("b"))
    rows = rows.select("universe", "b.gamma", "b.strategy", "month", (dotted - F.col("b.gamma") * 0.01).alias("ret"))
    return rows.join(state, ["universe", "month"])
