"""Quality of a labeling: silhouette over row pairs without a pair table, seed stability."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.passes import stack


def silhouette_rows(df: DataFrame, keys: Sequence[str], row: str, vector: str, label: str, n_blocks: int = 1) -> DataFrame:
    """Exact Euclidean silhouette of every row.

    Rows fall into ``n_blocks`` blocks by hash. A row visits every block once and leaves
    with its summed distance to each label there, so ``n_blocks`` copies of a row and a
    few sums travel, never a pair of rows. Choose the number of blocks so that one block
    of one model fits a task; the work is quadratic in the rows of one model, as the
    measure itself is.
    """
    base = df.select(*keys, F.col(row).alias("_row"), F.col(vector).alias("_x"), F.col(label).cast("long").alias("_l"))
    base = base.withColumn("_b", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int")).withColumn("_k", F.lit(0))
    targets = F.array(*[F.lit(i) for i in range(n_blocks)])
    visitors = base.select(*keys, "_k", "_row", "_x", F.col("_l").alias("_own"), F.col("_b").alias("_from"), F.explode(targets).alias("_b"))
    kinds = {f.name: f.dataType for f in base.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [
        T.StructField("_row", kinds["_row"]), T.StructField("_own", T.LongType()), T.StructField("_l", T.LongType()),
        T.StructField("_s", T.DoubleType()), T.StructField("_c", T.LongType())])

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        y = stack(right["_x"])
        labels, code = np.unique(right["_l"].to_numpy(), return_inverse=True)
        hot = np.eye(len(labels))[code]
        parts = []
        for start in range(0, len(left), 256):
            part = left.iloc[start : start + 256]
            d = np.sqrt(((stack(part["_x"])[:, None, :] - y[None]) ** 2).sum(axis=2))
            sums = d @ hot
            n = len(part)
            out = {k: np.repeat(part[k].to_numpy(), len(labels)) for k in (*keys, "_row", "_own")}
            out |= {"_l": np.tile(labels, n), "_s": sums.ravel(), "_c": np.tile(hot.sum(axis=0).astype(int), n)}
            parts.append(pd.DataFrame(out))
        return pd.concat(parts, ignore_index=True)[[f.name for f in schema.fields]]

    # the visitors' home block is part of the group, so that no task meets more than two blocks
    left = visitors.groupBy(*keys, "_k", "_b", "_from")
    fresh = [F.col(c).alias(c) for c in (*keys, "_k", "_row", "_x", "_l", "_b")]
    homes = base.select(*fresh, F.explode(targets).alias("_from"))
    met = left.cogroup(homes.groupBy(*keys, "_k", "_b", "_from")).applyInPandas(meet, schema)
    sums = met.groupBy(*keys, "_row", "_own", "_l").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    inside = F.max(F.when(F.col("_l") == F.col("_own"), F.struct("_s", "_c")))
    other = F.min(F.when(F.col("_l") != F.col("_own"), F.col("_s") / F.col("_c")))
    rows = sums.groupBy(*keys, "_row", "_own").agg(inside.alias("_in"), other.alias("_b"))
    alone = F.col("_in._c") <= 1
    a = F.col("_in._s") / F.nullif(F.col("_in._c") - 1, F.lit(0))
    s = F.when(alone, F.lit(0.0)).otherwise((F.col("_b") - a) / F.nullif(F.greatest(a, F.col("_b")), F.lit(0.0)))
    return rows.select(*keys, F.col("_row").alias(row), F.col("_own").alias(label), F.coalesce(s, F.lit(0.0)).alias("silhouette"))


def silhouette(df: DataFrame, keys: Sequence[str], row: str, vector: str, label: str, n_blocks: int = 1) -> DataFrame:
    """Mean silhouette per model; NULL when there is only one label."""
    rows = silhouette_rows(df, keys, row, vector, label, n_blocks)
    n_labels = F.count_distinct(label)
    out = rows.groupBy(*keys).agg(F.avg("silhouette").alias("_m"), n_labels.alias("_n"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", F.when(F.col("_n") > 1, F.col("_m")).alias("silhouette"))


def seed_stability(labels: DataFrame, row: Sequence[str], seed: str, label: str, reference: int, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, mean and population deviation of the adjusted Rand index of every seed against a reference seed."""
    from tidepanel.operators.stats import adjusted_rand

    base = labels.where(F.col(seed) == reference).select(*keys, *row, F.col(label).alias("_ref"))
    paired = labels.where(F.col(seed) != reference).join(base, [*keys, *row])
    ari = adjusted_rand(paired, "_ref", label, [*keys, seed])
    return ari.groupBy(*keys).agg(F.avg("ari").alias("ari_mean"), F.stddev_pop("ari").alias("ari_std"), F.count(F.lit(1)).alias("n_seeds"))
