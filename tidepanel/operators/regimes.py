"""Regime tables: transition matrices, naming, statistics per state and detection metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.expr import ratio


def transition_matrix(counts: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Row shares over the full ``k x k`` grid; rows without any transition stay zero."""
    keys = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    states = F.array(*[F.lit(i).cast("long") for i in range(k)])
    grid = keys.select(*by, F.explode(states).alias("from_state"))
    grid = grid.select(*by, "from_state", F.explode(states).alias("to_state"))
    full = grid.join(counts, [*by, "from_state", "to_state"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(*by, "from_state"))
    return full.withColumn("p", F.coalesce(ratio("n", total), F.lit(0.0)))


def statistics(df: DataFrame, regime: str, keys: Sequence[str], value: str, periods: int = 252) -> DataFrame:
    """Annualised mean and volatility per regime and series."""
    return df.groupBy(regime, *keys).agg(
        F.count(value).alias("n"),
        (F.avg(value) * periods).alias("ann_mean"),
        (F.stddev_samp(value) * F.sqrt(F.lit(float(periods)))).alias("ann_vol"),
    )


def support(df: DataFrame, state: str, crisis: Column, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """Months, share, crisis mark and recession overlap of every state."""
    out = df.groupBy(*keys, state).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.max(crisis.cast("int")).cast("long").alias("is_crisis"),
        F.round(100.0 * F.avg(F.when(F.col(flag) > 0, 1.0).otherwise(0.0)), 1).alias("overlap_pct"),
    )
    total = F.sum("n_months").over(Window.partitionBy(*keys))
    return out.withColumn("pct", F.round(100.0 * F.col("n_months") / total, 1))


def detection(df: DataFrame, predicted: Column, actual: Column, keys: Sequence[str] = (), digits: int | None = 3) -> DataFrame:
    """Recall, precision and F1 of a flag; zero where a ratio has no cases.

    ``digits=3`` rounds recall and precision before F1 is formed; ``None`` keeps all digits.
    """
    hit = lambda c: F.sum(c.cast("long"))
    counts = df.groupBy(*keys).agg(hit(predicted & actual).alias("tp"), hit(predicted & ~actual).alias("fp"), hit(~predicted & actual).alias("fn"))
    trim = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    recall = trim(F.coalesce(ratio("tp", F.col("tp") + F.col("fn")), F.lit(0.0)))
    precision = trim(F.coalesce(ratio("tp", F.col("tp") + F.col("fp")), F.lit(0.0)))
    out = counts.withColumn("recall", recall).withColumn("precision", precision)
    return out.withColumn("f1", trim(F.coalesce(ratio(2 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision")), F.lit(0.0))))


# The four names in order of assignment.
REGIME_NAMES = ["Crisis", "Steady_State", "WOI", "Inflation"]


def score_table(stats: DataFrame, regime: str, keys: Sequence[str] = (), series: str = "series_id", roles: Mapping[str, str] | None = None) -> DataFrame:
    """Four scores per regime from its factor means and equity volatility, each scaled to [0, 1] among the regimes."""
    names = {k: k for k in ("Equity", "Credit", "Short_Volatility", "Local_Inflation", "Commodities")} | dict(roles or {})
    pick = lambda role, c: F.coalesce(F.max(F.when(F.col(series) == names[role], F.col(c))), F.lit(0.0))
    wide = stats.groupBy(*keys, regime).agg(
        pick("Equity", "ann_mean").alias("eq"), pick("Credit", "ann_mean").alias("cr"), pick("Short_Volatility", "ann_mean").alias("sv"),
        pick("Local_Inflation", "ann_mean").alias("inf"), pick("Commodities", "ann_mean").alias("com"), pick("Equity", "ann_vol").alias("eqv"),
    )
    w = Window.partitionBy(*keys)
    unit = {c: (F.col(c) - F.min(c).over(w)) / (F.max(c).over(w) - F.min(c).over(w) + 1e-12) for c in ("eq", "cr", "sv", "inf", "com", "eqv")}
    wide = wide.select(*keys, regime, *[v.alias(k) for k, v in unit.items()])
    crisis = (1 - F.col("eq")) * 0.5 + (1 - F.col("cr")) * 0.3 + (1 - F.col("sv")) * 0.2
    wide = wide.withColumn("Crisis", crisis).withColumn("Steady_State", F.col("eq") * 0.7 + (1 - F.col("eqv")) * 0.3)
    mixed = (1 - F.col("eq")) * 0.3 + F.col("com") * 0.35 + F.col("inf") * 0.35
    return wide.withColumn("WOI", mixed * (1 - F.col("Crisis") * 0.8)).withColumn("Inflation", F.col("inf")).select(*keys, regime, *REGIME_NAMES)


def auto_names(scores: DataFrame, regime: str, keys: Sequence[str] = ()) -> DataFrame:
    """Greedy naming: each name in turn goes to the best unnamed regime (lowest number on a tie);
    surplus regimes take their best name with a letter suffix.

    A handful of regimes per model: four ordered picks over windows of that size.
    """
    out = scores.withColumn("name", F.lit(None).cast("string"))
    group = Window.partitionBy(*keys)
    for label in REGIME_NAMES:
        best = F.min_by(F.col(regime), F.when(F.col("name").isNull(), F.struct(-F.col(label), F.col(regime)))).over(group)
        out = out.withColumn("_best", best)
        out = out.withColumn("name", F.when(F.col("name").isNull() & (F.col(regime) == F.col("_best")), F.lit(label)).otherwise(F.col("name")))
    top = F.greatest(*REGIME_NAMES)
    favourite = F.coalesce(*[F.when(F.col(c) == top, F.lit(c)) for c in REGIME_NAMES])
    out = out.withColumn("_favourite", F.when(F.col("name").isNull(), favourite))
    order = F.row_number().over(Window.partitionBy(*keys, "_favourite").orderBy(regime))
    # the canonical holder of a name counts first, so suffixes start at A
    suffix = F.char(64 + order.cast("int"))
    return out.select(*keys, regime, F.coalesce("name", F.concat_ws("_", "_favourite", suffix)).alias("name"))


def latest_probabilities(scored: DataFrame, names: DataFrame, order: str, keys: Sequence[str] = (), regime: str = "state") -> DataFrame:
    """Named probabilities of the latest row per key, largest first."""
    last = scored.withColumn("_k", F.lit(0)).groupBy(*keys, "_k").agg(F.max_by("p", order).alias("p"), F.max(order).alias(order))
    cells = last.select(*keys, order, F.posexplode("p").alias(regime, "probability")).withColumn(regime, F.col(regime).cast("long"))
    named = cells.join(names, [*keys, regime], "left")
    label = F.coalesce("name", F.concat(F.lit("Regime_"), F.col(regime).cast("string")))
    return named.select(*keys, order, label.alias("name"), "probability").orderBy(*keys, F.col("probability").desc(), "name")


def relabel(names: DataFrame, changes: Mapping[int, str], regime: str) -> DataFrame:
    """Replace given names, keep the rest."""
    new = F.create_map(*[F.lit(x) for kv in changes.items() for x in kv])[F.col(regime).cast("int")]
    return names.withColumn("name", F.coalesce(new, F.col("name")))


def state_profile(df: DataFrame, state: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of several columns per state and feature."""
    return df.groupBy(state, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])
