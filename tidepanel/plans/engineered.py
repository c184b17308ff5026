"""Engineered monthly features as a declared list of expressions over named macro series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ordered as O

# Macro series the features need.
INPUTS = [
    "GS10", "TB3MS", "GS1", "GS5", "FEDFUNDS", "BAA", "AAA", "CPIAUCSL", "UNRATE", "S&P PE ratio", "S&P 500", "S&P div yield",
    "OILPRICEx", "M2SL", "BUSLOANS", "VIXCLSx",
]
# Plain differences of two series, all with transform code 1.
DIFFERENCES = {
    "YC_10Y3M": ("GS10", "TB3MS"), "YC_10Y1Y": ("GS10", "GS1"), "YC_5Y3M": ("GS5", "TB3MS"), "YC_10Y_FF": ("GS10", "FEDFUNDS"),
    "CREDIT_BAA10Y": ("BAA", "GS10"), "CREDIT_BAA_AAA": ("BAA", "AAA"), "CREDIT_AAA10Y": ("AAA", "GS10"),
}
# Yearly percent changes.
YEARLY = {"SPX_MOM12": "S&P 500", "INFL_YoY": "CPIAUCSL", "OIL_MOM12": "OILPRICEx", "CREDIT_GROWTH": "BUSLOANS"}
TCODES = {"VIX": 4}


def wide_inputs(df: DataFrame, keys: Sequence[str] = (), names: Mapping[str, str] | None = None, month: str = "month") -> DataFrame:
    """One row per month with a column per input; all months of a key are one calendar-bounded group."""
    names = names or {n: n for n in INPUTS}
    cells = [F.max(F.when(F.col("series_id") == names[n], F.col("value"))).alias(n) for n in INPUTS]
    return df.where(F.col("series_id").isin(*names.values())).groupBy(*keys, month).agg(*cells)


def engineered_features(df: DataFrame, keys: Sequence[str] = (), names: Mapping[str, str] | None = None, month: str = "month") -> DataFrame:
    """All features in long form ``(keys, month, series_id, value, tcode)`` without missing rows."""
    wide = wide_inputs(df, keys, names, month).withColumn("_k", F.lit(0))
    w = O.by([*keys, "_k"], month)
    c = lambda n: F.col(f"`{n}`")
    wide = wide.withColumn("_u3", O.rolling(c("UNRATE"), w, 3, "mean")).withColumn("_m2", c("M2SL") / F.nullif(c("CPIAUCSL"), F.lit(0.0)))
    yearly = lambda col: 100 * O.percent_change(col, w, 12)
    made: dict[str, Column] = {n: c(a) - c(b) for n, (a, b) in DIFFERENCES.items()}
    made |= {n: yearly(c(s)) for n, s in YEARLY.items()}
    wide = wide.select(*[F.col(f"`{x}`") for x in wide.columns], *[v.alias(n) for n, v in made.items()])
    inflation = F.col("INFL_YoY")
    rest: dict[str, Column] = {
        "REAL_FF": c("FEDFUNDS") - inflation,
        "REAL_10Y": c("GS10") - inflation,
        "SAHM": F.col("_u3") - O.rolling("_u3", w, 12, "min"),
        "UNRATE_12M_CHG": c("UNRATE") - F.lag(c("UNRATE"), 12).over(w),
        "SPX_TREND": 100 * (c("S&P 500") / F.nullif(O.rolling(c("S&P 500"), w, 12, "mean"), F.lit(0.0)) - 1),
        "SPX_PE": c("S&P PE ratio"),
        "SPX_DY": c("S&P div yield"),
        "ERP": 100.0 / F.nullif(c("S&P PE ratio"), F.lit(0.0)) - (c("GS10") - inflation),
        "M2_REAL_YoY": yearly(F.col("_m2")),
        "VIX": c("VIXCLSx"),
    }
    features = [*made, *rest]
    table = wide.select(*keys, month, *[F.col(n) for n in made], *[v.alias(n) for n, v in rest.items()])
    long = table.unpivot([*keys, month], features, "series_id", "value").where(F.col("value").isNotNull())
    code = F.coalesce(F.create_map(*[F.lit(x) for kv in TCODES.items() for x in kv])[F.col("series_id")], F.lit(1))
    return long.withColumn("tcode", code.cast("long"))
