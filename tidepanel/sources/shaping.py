"""Reshaping of raw inputs: wide text panels, embedded code rows, renames and small dimension maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(wide: DataFrame, ids: Sequence[str], columns: Sequence[str] | None = None, name: str = "series_id",
            value: str = "value") -> DataFrame:
    """Every column as number where it parses, in long form without the missing cells."""
    columns = list(columns) if columns is not None else [c for c in wide.columns if c not in ids]
    numbers = wide.select(*ids, *[F.col(f"`{c}`").try_cast("double").alias(c) for c in columns])
    long = numbers.unpivot(list(ids), [f"`{c}`" for c in columns], name, value)
    return long.where(F.col(value).isNotNull() & ~F.isnan(value))


def split_code_row(wide: DataFrame, date: str, marker: str = "Transform:") -> tuple[DataFrame, DataFrame]:
    """Split a wide text panel into long month data and the codes its marker row carries."""
    series = [c for c in wide.columns if c != date]
    codes = to_long(wide.where(F.startswith(F.col(date), F.lit(marker))), [date], series)
    codes = codes.select("series_id", F.col("value").cast("int").alias("tcode"))
    rows = wide.where(F.col(date).isNotNull() & ~F.startswith(F.col(date), F.lit(marker)))
    iso = F.try_to_date(F.col(date), "yyyy-MM-dd")
    slashed = F.try_to_date(F.col(date), "M/d/yyyy")
    rows = rows.withColumn("date", F.trunc(F.coalesce(iso, slashed), "month")).where("date IS NOT NULL")
    return to_long(rows, ["date"], series), codes


def parse_flag(text: DataFrame, date: str, value: str) -> DataFrame:
    """A dated 0/1 column as ``(month, flag)`` without missing rows."""
    out = text.select(
        F.trunc(F.try_to_date(F.col(date), "yyyy-MM-dd"), "month").alias("month"), F.col(value).try_cast("long").alias("flag")
    )
    return out.dropna()


def _literal_map(pairs: Mapping) -> F.Column:  # type: ignore[name-defined]
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def with_codes(df: DataFrame, codes: Mapping[str, int], default: int = 1, series: str = "series_id") -> DataFrame:
    """Attach the transform code of a fixed code list, ``default`` where it names none."""
    return df.withColumn("tcode", F.coalesce(_literal_map(codes)[F.col(series)], F.lit(default)))


def rename_known(df: DataFrame, names: Mapping[str, str], series: str = "series_id") -> DataFrame:
    """Rename the series of a fixed map and drop all others; the filter reaches the scan."""
    return df.where(F.col(series).isin(*names)).withColumn(series, _literal_map(names)[F.col(series)])


def with_daily_from(df: DataFrame, starts: Mapping[str, str], series: str = "series_id") -> DataFrame:
    """First daily date of series that were monthly before, NULL for the others."""
    return df.withColumn("daily_from", _literal_map(starts)[F.col(series)].cast("date"))


def flip_quotes(df: DataFrame, inverted: Sequence[str], value: str = "ret", series: str = "series_id") -> DataFrame:
    """Negate log returns of pairs quoted the other way round."""
    return df.withColumn(value, F.when(F.col(series).isin(*inverted), -F.col(value)).otherwise(F.col(value)))


def exclude(df: DataFrame, names: Sequence[str], series: str = "series_id") -> DataFrame:
    return df.where(~F.col(series).isin(*names)) if names else df


def name_states(df: DataFrame, names: Mapping[int, str], state: str, out: str, prefix: str = "Regime_") -> DataFrame:
    """Readable name of a state number, ``prefix + number`` where none was given."""
    known = _literal_map({int(k): v for k, v in names.items()})[F.col(state).cast("int")]
    return df.withColumn(out, F.coalesce(known, F.concat(F.lit(prefix), F.col(state).cast("string"))))


def walk_forward(df: DataFrame, keys: Sequence[str], train_years: int, step_months: int) -> DataFrame:
    """Refit dates of every key with the bounds of their train and test spans."""
    span = df.groupBy(*keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    first = F.add_months("_lo", 12 * train_years)
    count = F.floor(F.months_between("_hi", first) / step_months).cast("int")
    steps = F.when(first <= F.col("_hi"), F.sequence(F.lit(0), F.greatest(count, F.lit(0))))
    dated = span.select(*keys, "_hi", first.alias("_first"), F.explode(steps).alias("_k"))
    refit = F.add_months("_first", F.col("_k") * step_months)
    return dated.select(
        *keys, refit.alias("refit_date"), F.add_months(refit, -12 * train_years).alias("train_from"), F.add_months(refit, step_months).alias("test_to")
    )
