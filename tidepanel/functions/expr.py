"""Column expressions shared by the operators. Missing values are NULL, never NaN."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONDAY = "1970-01-05"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Half-up rounding that any IEEE engine reproduces bit for bit."""
    scale = 10.0**digits
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def finite(c: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """``a / b`` with NULL for a zero denominator."""
    return col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))


def safe_log(c: str | Column) -> Column:
    """Natural logarithm, NULL outside the domain."""
    c = col(c)
    return F.when(c > 0, F.log(c))


# ---- dates -------------------------------------------------------------------

def month_start(c: str | Column) -> Column:
    return F.trunc(col(c), "month")


def is_business_day(c: str | Column) -> Column:
    return F.weekday(col(c)) < 5


def business_index(c: str | Column) -> Column:
    """Consecutive number of a Monday-to-Friday day."""
    n = F.datediff(col(c), F.lit(MONDAY).cast("date"))
    week = F.floor(n / F.lit(7))
    return (week * 5 + F.least(n - week * 7, F.lit(4))).cast("long")


def parse_mixed_date(c: str | Column) -> Column:
    """A date text, or a spreadsheet serial number of days since 1899-12-30, else NULL."""
    c = col(c).cast("string")
    text = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.substr(1, 10).try_cast("date"))
    serial = F.when(c.rlike(r"^\d+(\.\d+)?$"), F.floor(c.try_cast("double")).cast("int"))
    return F.coalesce(text, F.date_add(F.lit("1899-12-30").cast("date"), serial))


def parse_compact_day(c: str | Column) -> Column:
    """``yyyymmdd`` as text or integer."""
    return F.try_to_date(col(c).cast("string"), "yyyyMMdd")


def parse_compact_month_end(c: str | Column) -> Column:
    """``yyyymm`` moved to the last day of its month."""
    return F.last_day(F.try_to_date(F.concat(col(c).cast("string"), F.lit("01")), "yyyyMMdd"))


# ---- rates -------------------------------------------------------------------

def annual_percent_to_daily(c: str | Column, days: int = 252) -> Column:
    return F.pow(1 + col(c) / 100.0, F.lit(1.0 / days)) - 1


def quarterly_to_annual_percent(c: str | Column) -> Column:
    return (F.pow(1 + col(c), F.lit(4.0)) - 1) * 100.0


# ---- short vectors -------------------------------------------------------------

def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def array_sum(a: str | Column) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, v: s + v)


def l2_norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scaled(a: str | Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(col(a), lambda v: v * f))


def argmax(a: str | Column) -> Column:
    """Zero-based position of the first largest element."""
    a = col(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


def argmin(a: str | Column) -> Column:
    a = col(a)
    return (F.array_position(a, F.array_min(a)) - 1).cast("long")


def normalised(a: str | Column) -> Column:
    """Non-negative shares that add up to one; uniform when nothing is left to share."""
    clipped = F.transform(col(a), lambda v: F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))

    def share(c: Column) -> Column:
        return let(array_sum(c), lambda t: F.transform(c, lambda v: F.when(t > 0, v / t).otherwise(F.lit(1.0) / F.size(c))))

    return let(clipped, share)


def euclidean(a: str | Column, b: str | Column) -> Column:
    diff = F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(array_sum(diff))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    return 1.0 - dot(a, b) / ((l2_norm(a) + 1e-12) * (l2_norm(b) + 1e-12))


def membership(distances: str | Column) -> Column:
    """Shares that fall with the distance: ``1 - d / sum(d)``, scaled to add up to one."""
    d = col(distances)
    raw = let(array_sum(d) + 1e-12, lambda t: F.transform(d, lambda v: 1.0 - v / t))
    return let(raw, lambda x: let(array_sum(x) + 1e-12, lambda t: F.transform(x, lambda v: v / t)))


def from_names(values: Sequence[str], c: str | Column) -> Column:
    """Zero-based index of a value in a fixed list, NULL if absent."""
    position = F.array_position(F.array(*[F.lit(v) for v in values]), col(c))
    return F.when(position > 0, (position - 1).cast("int"))
