"""Descriptive statistics: summaries, quantiles, frequencies, contingency (second moments are in ``moments``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import ratio
from tidepanel.session import kept


def factor_summary(df: DataFrame, keys: Sequence[str], value: str, periods: int = 252) -> DataFrame:
    """Annualised mean and volatility in percent and their ratio."""
    out = df.groupBy(*keys).agg(
        (F.avg(value) * periods * 100.0).alias("ann_mean_pct"),
        (F.stddev_samp(value) * (periods**0.5) * 100.0).alias("ann_vol_pct"),
    )
    return out.withColumn("ratio", ratio("ann_mean_pct", "ann_vol_pct"))


def frequency(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """Count and percentage (two decimals) of each value; the total runs over the few counted rows."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias(name))
    total = F.sum(name).over(Window.partitionBy())
    return counts.withColumn("pct", F.round(100.0 * F.col(name) / total, 2))


def mode_smallest(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent value per key, the smallest on a tie; counted first, so a hot key is one row per value."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value), F.max("_n").alias("n"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Exact quartiles of groups whose size a calendar bounds (``exact_quantiles`` takes any size)."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return q.select(*keys, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75")).withColumn(
        "iqr", F.col("q75") - F.col("q25")
    )


def joined(df: DataFrame, table: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``df`` with columns of a table that has one row per key; without keys its one row is a scalar of the plan, not a join."""
    if keys:
        return df.join(table.select(*keys, *columns), list(keys))
    row = table.select(F.struct(*columns).alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[c].alias(c) for c in columns])


BINS = 1 << 16


def _octave(v: Column) -> Column:
    """A digit that never falls as ``v`` grows: 64 steps per factor of two, on both sides of zero; at most about 280,000 values."""
    size = F.floor(F.log2(F.abs(v)) * 64) + 70_000
    finite = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), 400_000).when(v == float("inf"), 300_000).when(v == float("-inf"), -300_000).otherwise(finite).cast("long")


def _share(v: Column, lo: Column, hi: Column) -> Column:
    """A digit that never falls as ``v`` grows from ``lo`` to ``hi``: its place among ``BINS`` equal steps."""
    part = (v - lo) / (hi - lo)
    return F.when((hi > lo) & ~F.isnan(part), F.least(F.floor(part * BINS), F.lit(BINS - 1))).otherwise(0).cast("long")


def _chosen(counts: DataFrame, group: Sequence[str], targets: DataFrame | None, probs: Sequence[float]) -> DataFrame:
    """The bins (of ``counts``: group, _digit, _c, _lo, _hi) that hold the wanted places, with each place counted from its bin's first row.

    The first time (no targets) the places follow from the groups' sizes: the two ranks around every probability.
    """
    w = Window.partitionBy(*group)
    upto = F.sum("_c").over(w.orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_before", upto - F.col("_c"))
    if targets is None:
        n = F.sum("_c").over(w)
        at = [(i, F.col("_n") - 1, p) for i, p in enumerate(probs)]
        wanted = [
            F.struct(F.lit(i).alias("q"), F.lit(side).alias("side"), F.least(F.floor(last * F.lit(float(p))).cast("long") + side, last).alias("place"),
                     (last * F.lit(float(p)) - F.floor(last * F.lit(float(p)))).alias("share"))
            for i, last, p in at for side in (0, 1)
        ]
        tagged = placed.withColumn("_n", n).withColumn("_t", F.explode(F.array(*wanted)))
        tagged = tagged.select(*counts.columns, "_before", "_t.*")
    else:
        tagged = placed.join(targets, list(group))
    here = (F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("_c"))
    return tagged.where(here).withColumn("place", F.col("place") - F.col("_before"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact interpolated quantiles of groups of any size, by refining histograms.

    The two rows around a quantile are found by place. Rows are counted by a digit that grows with the
    value, the bins that hold wanted places are kept, and their rows are counted by the next digit:
    the octave, two linear digits of ``BINS`` steps between the kept bin's ends, then the
    few different values left. Rows are only ever counted, with partial aggregates; windows
    run over bins. No group is gathered or ordered, and rows that no bin kept leave at the first join.
    """
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + 0.0).alias("_v"))
    ends = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]

    bins = data.withColumn("_digit", _octave(F.col("_v")))
    found = _chosen(bins.groupBy(*keys, "_digit").agg(*ends), keys, None, probs)
    path = ["_d0"]
    found = kept(found.withColumnRenamed("_digit", "_d0"))  # a few rows per group; each level reads the one before
    data = bins.withColumnRenamed("_digit", "_d0")
    for level in (1, 2, 3):
        group = [*keys, *path]
        bounds = found.select(*group, "_lo", "_hi").distinct()
        inside = data.join(bounds, group)
        digit = _share(F.col("_v"), F.col("_lo"), F.col("_hi")) if level < 3 else F.col("_v")
        inside = inside.withColumn("_digit", digit).drop("_lo", "_hi")
        targets = found.select(*group, "q", "side", "place", "share")
        found = _chosen(inside.groupBy(*group, "_digit").agg(*ends), group, targets, probs).withColumnRenamed("_digit", f"_d{level}")
        found = kept(found) if level < 3 else found
        data = inside.withColumnRenamed("_digit", f"_d{level}")
        path.append(f"_d{level}")
    sides = found.groupBy(*keys, "q").agg(
        F.max(F.when(F.col("side") == 0, F.col("_lo"))).alias("_low"), F.max(F.when(F.col("side") == 1, F.col("_lo"))).alias("_high"), F.max("share").alias("_share")
    )
    exact = F.when(F.col("_share") == 0, F.col("_low")).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share"))
    return sides.groupBy(*keys).agg(*[F.max(F.when(F.col("q") == i, exact)).alias(n) for i, n in enumerate(names)])


def tail_risk(df: DataFrame, keys: Sequence[str], ret: str, eta: float = 0.95) -> DataFrame:
    """Quantile of the losses and the mean of losses at or beyond it, per calendar-bounded group."""
    loss = df.where(F.col(ret).isNotNull()).select(*keys, (-F.col(ret)).alias("_loss"))
    losses = loss.groupBy(*keys).agg(F.percentile("_loss", F.lit(eta)).alias("var"), F.array_agg("_loss").alias("_l"))
    tail = F.filter("_l", lambda v: v >= F.col("var"))
    mean = F.aggregate(F.array_sort(tail), F.lit(0.0), lambda s, v: s + v) / F.size(tail)
    return losses.select(*keys, "var", mean.alias("cvar"))


# ---- agreement of labelings ----------------------------------------------------------

def adjusted_rand(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts.

    Pairs within cells, within rows and within columns of the table are added up in one aggregate, without a join.
    """

    def pairs(c):
        c = F.col(c).cast("double")
        return c * (c - 1) / 2

    cells = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_n"))
    parts = None
    for name, kept in (("_ab", [a, b]), ("_a", [a]), ("_b", [b])):
        counts = cells if name == "_ab" else cells.groupBy(*keys, *kept).agg(F.sum("_n").alias("_n"))
        part = counts.select(*keys, *[(pairs("_n") if c == name else F.lit(0.0)).alias(c) for c in ("_ab", "_a", "_b")], (F.col("_n") if name == "_ab" else F.lit(0).cast("long")).alias("n"))
        parts = part if parts is None else parts.unionByName(part)
    joined = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_ab", "_a", "_b", "n")])
    expected = F.col("_a") * F.col("_b") / F.nullif(pairs("n"), F.lit(0.0))
    middle = (F.col("_a") + F.col("_b")) / 2
    index = F.when(expected.isNull() | (middle == expected), F.lit(1.0)).otherwise((F.col("_ab") - expected) / F.nullif(middle - expected, F.lit(0.0)))
    return joined.select(*keys, "n", index.alias("ari"))
