"""Long panels ``(keys..., date, value)``: deduplication, alignment, filling and filtering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import ordered as O
from tidepanel.functions.expr import business_index, is_business_day

SERIES = ("series_id",)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``.

    A maximum merges partially on the map side, so a key that owns much of the input
    reaches the shuffle as one row per task.
    """
    df = df.dropna(subset=list(keys))
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, "_last.*")


def coverage(df: DataFrame, keys: Sequence[str] = SERIES, value: str = "price") -> DataFrame:
    """Number of observations, first and last date of every series."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_obs"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    )


def business_calendar(df: DataFrame, keys: Sequence[str], start: str | Column, end: str | Column) -> DataFrame:
    """One row per key and Monday-to-Friday day, generated from the distinct keys."""
    lo = F.lit(start).cast("date") if isinstance(start, str) else start
    hi = F.lit(end).cast("date") if isinstance(end, str) else end
    days = F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias("date")
    return df.select(*keys).distinct().select(*keys, days).where(is_business_day("date"))


def align_to_calendar(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    start: str,
    end: str,
    limit: int = 5,
    monthly_limit: int = 35,
    daily_from: str | None = None,
) -> DataFrame:
    """Business-day panel with a limited forward fill, from one shuffle and no join.

    Every observation produces its own calendar rows up to the day before the next one:
    the first ``limit`` business days carry its value, later ones are NULL. Leading days
    are NULL, weekend observations are dropped first. With ``daily_from`` (a date column,
    NULL for purely daily series) the rows before it form a monthly section with its own
    limit, and nothing is carried across the boundary.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    day = F.expr("interval 1 day")
    inside = df.where(is_business_day("date") & F.col("date").between(lo, hi) & F.col(value).isNotNull())
    split = F.coalesce(F.col(daily_from), lo) if daily_from else lo
    inside = inside.withColumn("_split", split).withColumn("_daily", F.col("date") >= F.col("_split"))

    w = O.by(keys)
    marked = inside.withColumn("_next", F.lead("date").over(w)).withColumn("_first", F.lag("date").over(w).isNull())
    gap_end = F.date_sub(F.coalesce(F.col("_next"), F.date_add(hi, 1)), 1)
    own_from = F.when(F.col("_first"), F.least(lo, F.col("date"))).otherwise(F.col("date"))
    dense = marked.withColumn("_day", F.explode(F.sequence(own_from, gap_end, day))).where(is_business_day("_day"))

    age = business_index("_day") - business_index("date")
    same_section = (F.col("_day") >= F.col("_split")) == F.col("_daily")
    allowed = F.when(F.col("_daily"), F.lit(limit)).otherwise(F.lit(monthly_limit))
    carried = F.when((age >= 0) & (age <= allowed) & same_section, F.col(value))
    extra = [daily_from] if daily_from else []
    return dense.select(*keys, F.col("_day").alias("date"), carried.alias(value), *extra)


def strip_stale(df: DataFrame, keys: Sequence[str], value: str, limit: int = 5, section: str | None = None) -> DataFrame:
    """Values equal to the previous row become NULL and are filled again for ``limit`` rows,
    so only longer flat runs end up missing."""
    groups = [*keys, section] if section else list(keys)
    w = O.by(groups)
    out = O.with_position(df, groups, name="_pos")
    out = out.withColumn("_fresh", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(None)).otherwise(F.col(value)))
    return out.withColumn(value, O.forward_fill("_fresh", w, limit, "_pos")).drop("_pos", "_fresh")


def as_of(keys_df: DataFrame, values_df: DataFrame, by: Sequence[str], values: Sequence[str], on: str = "date") -> DataFrame:
    """Latest value at or before each requested date: union of requests and values, then one ordered pass."""
    requests = keys_df.select(*by, on, F.lit(True).alias("_request"), *[F.lit(None).cast(values_df.schema[v].dataType).alias(v) for v in values], F.lit(False).alias("_known"))
    known = values_df.select(*by, on, F.lit(False).alias("_request"), *values, F.lit(True).alias("_known"))
    w = O.running(Window.partitionBy(*by).orderBy(F.col(on), F.col("_request")))
    packed = F.last(F.when(F.col("_known"), F.struct(*values)), ignorenulls=True).over(w)
    return (
        requests.unionByName(known)
        .withColumn("_found", packed)
        .where("_request")
        .select(*by, on, *[F.col("_found")[v].alias(v) for v in values])
    )


def log_returns(df: DataFrame, keys: Sequence[str] = SERIES, price: str = "price", name: str = "ret") -> DataFrame:
    return df.withColumn(name, O.log_return(price, O.by(keys)))


def per_date(df: DataFrame) -> DataFrame:
    """Mark a table with one row per calendar day for broadcasting.

    Its size is bounded by the calendar, not by the data: a century of days with a few
    numbers each is a few megabytes. The alternative, regrouping a panel by date, would
    put every series of a day into one task.
    """
    return F.broadcast(df)


def drop_empty_dates(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Drop dates on which no series has a value.

    The kept dates come from a partial aggregation over dates, so the panel itself is not
    regrouped by date.
    """
    kept = df.where(F.col(value).isNotNull()).select(date).distinct()
    return df.join(per_date(kept), date, "left_semi")


def complete_groups(df: DataFrame, group: Sequence[str], value: str, n: int | Column) -> DataFrame:
    """Keep the groups in which exactly ``n`` values are known."""
    counts = df.groupBy(*group).agg(F.count(value).alias("_known"))
    return df.join(counts.where(F.col("_known") == n).select(*group), list(group), "left_semi")


def null_fraction_rows(df: DataFrame, threshold: float, n_series: int, date: str = "date", value: str = "value",
                       by: Sequence[str] = ()) -> DataFrame:
    """Keep dates whose missing values number at most ``int(threshold * n_series)``; absent rows count as missing."""
    allowed = int(threshold * n_series)
    known = df.groupBy(*by, date).agg(F.count(value).alias("_known"))
    kept = known.where(F.lit(n_series) - F.col("_known") <= allowed).select(*by, date)
    return df.join(kept if by else per_date(kept), [*by, date], "left_semi")


def drop_sparse_series(df: DataFrame, keys: Sequence[str], value: str, n_rows: int | Column, min_share: float) -> DataFrame:
    """Keep series with at least ``int(min_share * n_rows)`` known values."""
    counts = df.groupBy(*keys).agg(F.count(value).alias("_known"))
    bound = F.floor(F.lit(min_share) * (F.lit(n_rows) if isinstance(n_rows, int) else n_rows))
    return df.join(counts.where(F.col("_known") >= bound).select(*keys), list(keys), "left_semi")


def first_available(df: DataFrame, choices: Mapping[str, Sequence[str]], series: str = "series_id") -> DataFrame:
    """Rename the first existing series of each list to the role's name.

    ``choices`` maps a role to its candidates in order of preference. A role without any
    candidate in the panel raises when the result is read.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame(
        [(role, s, i) for role, names in choices.items() for i, s in enumerate(names)], "role string, _series string, _rank int"
    )
    present = df.select(F.col(series).alias("_series")).distinct()
    best = wanted.join(present.withColumn("_here", F.lit(True)), "_series", "left")
    best = best.groupBy("role").agg(F.min_by("_series", F.when(F.col("_here"), F.col("_rank"))).alias("_series"))
    best = best.withColumn(
        "_series", F.coalesce("_series", F.raise_error(F.concat(F.lit("no series available for "), F.col("role"))).cast("string"))
    )
    renamed = df.withColumnRenamed(series, "_series").join(F.broadcast(best), "_series")
    return renamed.drop("_series")


def coalesce_sources(df: DataFrame, keys: Sequence[str], source: str, value: str, priority: Sequence[str]) -> DataFrame:
    """First known value per key in the order of ``priority``, one shuffle for any number of sources."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(source))
    known = df.where((rank > 0) & F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.min_by(value, rank).alias(value), F.min_by(source, rank).alias(source))


def spread(df: DataFrame, left: str, right: str, name: str, how: str = "difference", series: str = "series_id",
           value: str = "value", date: str = "date", by: Sequence[str] = ()) -> DataFrame:
    """``left - right`` or ``left / right`` per date, NULL unless both are known."""
    a = F.max(F.when(F.col(series) == left, F.col(value)))
    b = F.max(F.when(F.col(series) == right, F.col(value)))
    combined = a - b if how == "difference" else a / F.nullif(b, F.lit(0.0))
    chosen = df.where(F.col(series).isin(left, right))
    return chosen.groupBy(*by, date).agg(combined.alias(value)).select(*by, date, F.lit(name).alias(series), value)


def month_end_hold(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Last known value of each month applies from that month's last calendar day until the next one."""
    month = (F.year("date") * 12 + F.month("date")).cast("int")
    out = df.withColumn("_month", month)
    w = Window.partitionBy(*keys).orderBy("_month")
    at = F.when(F.col(value).isNotNull(), F.col("date"))
    own = F.max_by(value, at).over(w.rangeBetween(0, 0))
    before = F.max_by(value, at).over(w.rangeBetween(-1, -1))
    held = F.when(F.col("date") == F.last_day("date"), own).otherwise(before)
    return out.withColumn("_held", held).withColumn(value, F.col("_held")).drop("_held", "_month")


def tail_rows(df: DataFrame, keys: Sequence[str], n: int, order: str = "date") -> DataFrame:
    """Last ``n`` rows of every series (the reporting window of a current-state query)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= n).drop("_back")
