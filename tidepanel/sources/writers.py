"""Named result tables on disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), max_records: int = 5_000_000) -> None:
    """Write one table; CSV output holds arrays as JSON text."""
    if fmt == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        df = df.select(*[F.to_json(c).alias(c) if c in nested else c for c in df.columns])
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", max_records)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def write_all(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet", partition_by: Mapping[str, Sequence[str]] | None = None) -> None:
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", fmt, (partition_by or {}).get(name, ()))
