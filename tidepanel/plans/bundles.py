"""Feature bundles: which blocks of monthly series enter a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.stats import joined

# Exchange-rate series of the macro panel, and its full interest and exchange group.
EXCHANGE_SERIES = ["TWEXAFEGSMTHx", "TWEXMMTH", "EXSZUSx", "EXJPUSx", "EXUSUKx", "EXCAUSx"]
INTEREST_SERIES = [
    "FEDFUNDS", "CP3Mx", "TB3MS", "TB6MS", "GS1", "GS5", "GS10", "AAA", "BAA", "COMPAPFFx", "TB3SMFFM", "TB6SMFFM", "T1YFFM", "T5YFFM",
    "T10YFFM", "AAAFFM", "BAAFFM",
]
EXCLUSIONS = {"exchange": EXCHANGE_SERIES, "group6": INTEREST_SERIES + EXCHANGE_SERIES, "none": []}

# The blocks of each bundle.
BUNDLES = {
    "macro": ["macro"],
    "macro+eng": ["macro", "eng"],
    "comb": ["macro", "eng", "alt"],
    "alt": ["alt"],
}


def bundles(macro: DataFrame, engineered: DataFrame, alternative: DataFrame, since: str = "1976-01-01", exclude: str = "exchange",
            max_missing: float = 0.5) -> DataFrame:
    """All bundles as one long panel ``(bundle, month, series_id, value, tcode)``.

    Engineered and alternative series are cut to the macro months; alternative series with
    more than half of those months missing drop out.
    """
    columns = ["month", "series_id", "value", "tcode"]
    inside = macro.where(F.col("month") >= F.lit(since).cast("date")).select(*columns)
    months = inside.select("month").distinct()
    n_months = months.agg(F.count(F.lit(1)).alias("_n"))
    alt = alternative.join(months, "month", "left_semi").select(*columns)
    known = joined(alt.groupBy("series_id").agg(F.count("value").alias("_known")), n_months, [], ["_n"])
    kept = known.where(F.col("_n") - F.col("_known") <= max_missing * F.col("_n")).select("series_id")
    blocks = (
        inside.withColumn("block", F.lit("macro"))
        .unionByName(engineered.join(months, "month", "left_semi").select(*columns).withColumn("block", F.lit("eng")))
        .unionByName(alt.join(kept, "series_id", "left_semi").select(*columns).withColumn("block", F.lit("alt")))
    )
    blocks = blocks.where(~F.col("series_id").isin(*EXCLUSIONS[exclude])) if EXCLUSIONS[exclude] else blocks
    member = F.filter(
        F.array(*[F.struct(F.lit(b).alias("bundle"), F.array(*[F.lit(x) for x in parts]).alias("parts")) for b, parts in BUNDLES.items()]),
        lambda b: F.array_contains(b["parts"], F.col("block")),
    )
    tagged = blocks.select(*columns, F.explode(member).alias("_b"))
    # the alternative bundle also lives on the macro months: a month without any value stays a month
    return tagged.select(F.col("_b.bundle").alias("bundle"), *columns)
