"""File sources as long panels.

Every reader is lazy and returns rows without missing keys, one per key (the last in file
order). File order is file name, offset of the split and number inside the split, all of
which Spark reports, so no global numbering is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.expr import finite, normalised, parse_compact_day, parse_compact_month_end, parse_mixed_date
from tidepanel.operators.panel import keep_last
from tidepanel.sources import schemas as C
from tidepanel.sources import shaping as H


def _csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", False)
    return reader.csv(path)


def _ordered(df: DataFrame) -> DataFrame:
    """Attach the file, and the offset of the row's split with its running number inside the task."""
    line = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("number"))
    return df.select("*", F.col("_metadata.file_path").alias("_file"), line.alias("_line"))


def _date(c: str) -> Column:
    return F.coalesce(F.try_to_date(F.col(c), "yyyy-MM-dd"), F.try_to_date(F.col(c), "M/d/yyyy"), parse_mixed_date(c))


def read_prices(spark: SparkSession, paths: str | Sequence[str], catalog: DataFrame | None = None, series_pattern: str = r"([^/_]+)_[^/]*$",
                daily_from: Mapping[str, str] | None = None, daily_only: bool = False) -> DataFrame:
    """Many price files as ``(series_id, date, price)``.

    The series name is the catalogue's ticker for the file name, or else the part of the
    file name before the first underscore. Dates may be text or spreadsheet serials.
    """
    raw = _ordered(_csv(spark, paths, C.PRICES))
    raw = raw.select(F.regexp_extract("_file", r"([^/]+)$", 1).alias("file_name"), parse_mixed_date("Date").alias("date"),
                     finite(F.col("Price").try_cast("double")).alias("price"), "_file", "_line")
    if catalog is not None:
        names = catalog.select(F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("_stem"), F.split("ticker", " ")[0].alias("series_id"))
        stem = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1)
        raw = raw.withColumn("_stem", stem).join(names, "_stem").drop("_stem")
    else:
        raw = raw.withColumn("series_id", F.regexp_extract("_file", series_pattern, 1))
    panel = keep_last(raw, ["series_id", "date"], ["_file", "_line"], ["price"])
    if daily_only and daily_from:
        tagged = H.with_daily_from(panel, daily_from)
        panel = tagged.where(F.col("date") >= F.coalesce("daily_from", "date")).drop("daily_from")
    return panel


def read_factors(spark: SparkSession, path: str, monthly: bool = False) -> DataFrame:
    """Factor returns with a descriptive head, compact dates and percent values, as decimals in long form."""
    raw = _ordered(_csv(spark, path, C.FACTORS, header=False))
    # descriptive lines and the header do not parse as dates and drop out
    date = parse_compact_month_end("Date") if monthly else parse_compact_day("Date")
    digits = F.regexp_extract(F.trim("Date"), r"^(\d+)$", 1)
    raw = raw.withColumn("Date", F.when(F.length(digits) == (6 if monthly else 8), digits)).withColumn("date_", date).where("date_ IS NOT NULL")
    names = [f.name for f in C.FACTORS.fields[1:]]
    wide = keep_last(raw.withColumn("date", F.col("date_")).drop("date_"), ["date"], ["_file", "_line"], names)
    return H.to_long(wide, ["date"], names).withColumn("value", F.col("value") / 100.0)


def read_wide_dates(spark: SparkSession, path: str, date: str, names: Mapping[str, str] | None = None) -> DataFrame:
    """A dated wide file (rates, quarterly bills, currency quotes, alternative data) in long form.

    ``names`` renames provider columns and keeps only those.
    """
    raw = _ordered(_csv(spark, path))
    columns = [c for c in raw.columns if c not in (date, "_file", "_line") and (names is None or c in names)]
    wide = raw.select(_date(date).alias("date"), *[F.col(f"`{c}`").alias((names or {}).get(c, c)) for c in columns], "_file", "_line")
    kept = keep_last(wide, ["date"], ["_file", "_line"], [(names or {}).get(c, c) for c in columns])
    return H.to_long(kept, ["date"])


def read_currencies(spark: SparkSession, path: str, date: str = "Date") -> DataFrame:
    return read_wide_dates(spark, path, date, C.FX_COLUMNS)


def read_annual(spark: SparkSession, path: str, year: str = "Year") -> DataFrame:
    """Annual country table as ``(year, series_id, value)``."""
    raw = _csv(spark, path)
    countries = [c for c in raw.columns if c != year]
    wide = raw.select(F.col(year).try_cast("long").alias("year"), *[F.col(f"`{c}`") for c in countries])
    return H.to_long(wide, ["year"], countries)


def read_macro(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Monthly macro file with its code row: long data and codes."""
    wide = _csv(spark, path)
    return H.split_code_row(wide, wide.columns[0])


def read_flag(spark: SparkSession, path: str) -> DataFrame:
    return H.parse_flag(_csv(spark, path, C.FLAG), "observation_date", "USREC")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, C.CODES).select(F.col("column").alias("series_id"), F.col("tcode").try_cast("int").alias("tcode")).dropna()


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, C.CATALOG)


def read_asset_returns(spark: SparkSession, path: str, month: str = "month") -> DataFrame:
    """Monthly asset returns in long form ``(universe, month, asset, ret)``."""
    long = read_wide_dates(spark, path, month)
    return long.select(F.lit("all").alias("universe"), F.trunc("date", "month").alias("month"), F.col("series_id").alias("asset"), F.col("value").alias("ret"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """State file ``(month, state, crisis, p_crisis, p)``; the date column is probed, probabilities add up to one."""
    raw = _csv(spark, path)
    date = next((c for c in ("date", "sasdate", "month") if c in raw.columns), raw.columns[0])
    marks = sorted((c for c in raw.columns if c.startswith("p_state")), key=lambda c: int(c.replace("p_state", "").strip("_")))
    p = normalised(F.array(*[F.col(c).try_cast("double") for c in marks]))
    optional = {c: (F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")) for c in ("crisis", "p_crisis")}
    return raw.select(F.trunc(_date(date), "month").alias("month"), F.col("state").try_cast("int").alias("state"), *[v.alias(k) for k, v in optional.items()], p.alias("p"))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def manifest(spark: SparkSession, folder: str, expected: Sequence[str] = (), digest: bool = True) -> DataFrame:
    """Name, size and hash prefix of the files of a folder.

    An expected name that is missing raises when the result is read. Without ``digest``
    the content column is never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
        (F.substring(F.sha2("content", 256), 1, 12) if digest else F.lit(None).cast("string")).alias("sha256"),
    )
    if not expected:
        return found
    wanted = spark.createDataFrame([(n,) for n in expected], "name string")
    joined = wanted.join(found, "name", "left")
    missing = F.raise_error(F.concat(F.lit("required input missing: "), F.col("name"))).cast("double")
    return joined.withColumn("size_mb", F.coalesce("size_mb", missing))
