"""Ordered expressions over one series.

A panel is unique on ``(keys, date)`` (``operators.panel.keep_last`` makes it so), so a
window over one series holds at most one row per calendar day: about 37,000 rows for a
century. That bound, not the size of the data, limits what a single task sorts. Event
sequences have no such bound and use ``operators.sequences`` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidepanel.functions.expr import col, safe_log


def by(keys: Sequence[str], order: str | Sequence[str] = "date") -> WindowSpec:
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def backwards(keys: Sequence[str], order: str = "date") -> WindowSpec:
    """The same series read from its end.

    A frame that reaches from the current row to the end is evaluated anew for every row;
    read backwards it only grows, which is linear for the price of a second sort.
    """
    return running(Window.partitionBy(*keys).orderBy(F.col(order).desc()))


def log_return(price: str | Column, w: WindowSpec) -> Column:
    price = col(price)
    before = F.lag(price).over(w)
    return F.when((price > 0) & (before > 0), F.log(price / before))


def forward_fill(value: str | Column, w: WindowSpec, limit: int | Column | None = None,
                 position: str | Column | None = None) -> Column:
    """Last known value, at most ``limit`` rows old.

    The frame only grows, so the work per row is constant for any limit. ``position`` is
    the row's number in its series (a column, see ``with_position``), needed for a limit.
    """
    value = col(value)
    last = F.last(value, ignorenulls=True).over(running(w))
    if limit is None:
        return last
    position = col(position)
    age = position - F.last(F.when(value.isNotNull(), position), ignorenulls=True).over(running(w))
    return F.when(age <= limit, last)


def backward_fill(value: str | Column, keys: Sequence[str], order: str = "date") -> Column:
    """Next known value."""
    return F.last(col(value), ignorenulls=True).over(backwards(keys, order))


def rolling(value: str | Column, w: WindowSpec, n: int, how: str, min_count: int | None = None) -> Column:
    """Rolling mean, sum, min, max or std; NULL until ``min_count`` (default ``n``) values are present."""
    frame = w.rowsBetween(-(n - 1), 0)
    function = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp}[how]
    value = col(value)
    return F.when(F.count(value).over(frame) >= (n if min_count is None else min_count), function(value).over(frame))


def with_position(df: DataFrame, keys: Sequence[str], order: str | Sequence[str] = "date",
                  name: str = "position") -> DataFrame:
    """Number the rows of every series from 1."""
    return df.withColumn(name, F.row_number().over(by(keys, order)))


def with_long_rolling(df: DataFrame, keys: Sequence[str], value: str, n: int, min_count: int,
                      total: str | None = None, std: str | None = None, order: str = "date") -> DataFrame:
    """Rolling sum and sample std over long windows as differences of running sums.

    A sliding frame re-adds all ``n`` rows for every row; running sums cost the same for
    any ``n``. Meant for values around zero, such as returns, where the difference of two
    running sums keeps its digits.
    """
    w = by(keys, order)
    v = F.col(value)
    out = (
        df.withColumn("_n", F.count(v).over(running(w)))
        .withColumn("_s", F.coalesce(F.sum(v).over(running(w)), F.lit(0.0)))
        .withColumn("_q", F.coalesce(F.sum(v * v).over(running(w)), F.lit(0.0)))
    )
    for c in ("_n", "_s", "_q"):
        out = out.withColumn(f"{c}w", F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0)))
    if total:
        out = out.withColumn(total, F.when(F.col("_nw") >= min_count, F.col("_sw")))
    if std:
        variance = (F.col("_qw") - F.col("_sw") * F.col("_sw") / F.col("_nw")) / F.nullif(F.col("_nw") - 1, F.lit(0))
        out = out.withColumn(
            std, F.when(F.col("_nw") >= max(min_count, 2), F.sqrt(F.greatest(variance, F.lit(0.0))))
        )
    return out.drop("_n", "_s", "_q", "_nw", "_sw", "_qw")


def transform_by_code(value: str | Column, code: str | Column, w: WindowSpec) -> Column:
    """Stationarity code: 1 level, 2 first and 3 second difference, 4 log, 5 first and 6 second
    difference of the log, 7 first difference of the relative change."""
    value, code = col(value), col(code)
    logged = safe_log(value)

    def first(c: Column) -> Column:
        return c - F.lag(c, 1).over(w)

    def second(c: Column) -> Column:
        return (c - F.lag(c, 1).over(w)) - (F.lag(c, 1).over(w) - F.lag(c, 2).over(w))

    def change(k: int) -> Column:
        now = value if k == 0 else F.lag(value, k).over(w)
        return now / F.nullif(F.lag(value, k + 1).over(w), F.lit(0.0)) - 1.0

    return (
        F.when(code == 1, value)
        .when(code == 2, first(value))
        .when(code == 3, second(value))
        .when(code == 4, logged)
        .when(code == 5, first(logged))
        .when(code == 6, second(logged))
        .when(code == 7, change(0) - change(1))
        .otherwise(F.raise_error(F.concat(F.lit("unknown transform code "), code.cast("string"))))
    )


def percent_change(value: str | Column, w: WindowSpec, periods: int) -> Column:
    """Relative change over ``periods`` rows of the forward-filled series."""
    filled = forward_fill(value, w)
    return filled / F.nullif(lag_filled(value, w, periods), F.lit(0.0)) - 1.0


def lag_filled(value: str | Column, w: WindowSpec, periods: int) -> Column:
    frame = w.rowsBetween(Window.unboundedPreceding, -periods)
    return F.last(col(value), ignorenulls=True).over(frame)


def interpolated(value: str | Column, keys: Sequence[str], order: str = "date", position: str | Column = "position") -> Column:
    """Positional linear interpolation; both ends take the nearest known value."""
    value, position = col(value), col(position)
    known = F.when(value.isNotNull(), F.struct(position.alias("at"), value.alias("v")))
    left = F.last(known, ignorenulls=True).over(running(by(keys, order)))
    right = F.last(known, ignorenulls=True).over(backwards(keys, order))
    between = left["v"] + (right["v"] - left["v"]) * (position - left["at"]) / F.nullif(right["at"] - left["at"], F.lit(0))
    return F.when(value.isNotNull(), value).when(left.isNull(), right["v"]).when(right.isNull(), left["v"]).otherwise(between)


def average_rank(value: str | Column, keys: Sequence[str], descending: bool = True) -> Column:
    """Rank with ties sharing their mean position."""
    value = col(value)
    ordered = Window.partitionBy(*keys).orderBy(value.desc() if descending else value.asc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.rank().over(ordered) + (ties - 1) / 2.0
