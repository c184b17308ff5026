"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected copies, target over size, at most 2.
Documents are ordered by size class, hash bucket, doc_id and a hash of the text; the prefix sums of expected copies
start from one offset per source, and a document is taken once per integer crossed.

Cases: a null text has size 0; a null source is a source of its own, ordered last; ties
and repeated rows are separate documents; an empty table gives an empty table; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import col, fresh, n_words

# Weights by position of the source, share of all words, and the most a source may be repeated.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def targets(sizes: DataFrame) -> DataFrame:
    """Add weight and target to one row per source (is_null, name, size): filled by weight up to MOST times the size.

    Sources in order of cap per weight: those filled up form a prefix, so the common level
    is that of the first source not filled.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy("is_null", "name")))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("k") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", MOST * F.col("size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (SHARE * F.sum("size").over(everything) - F.col("filled")) / (F.sum("weight").over(everything) - F.col("passed"))
    ranked = ranked.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("o"), "k", "level"))).over(everything)["level"]
    return ranked.withColumn("target", F.least("cap", F.coalesce(open_level, F.lit(float("inf"))) * F.col("weight"))).drop("k", "cap", "filled", "passed", "level")


def mixed(docs: DataFrame, seed: int = 11, bucket_rows: int = 100_000) -> tuple[DataFrame, str]:
    """``docs`` with one more column, a struct (size, source_size, target, copies), and that column's name."""
    m, null, name, size, group, bucket, rn, tie = fresh(docs, "mix", "is_null", "name", "size", "class", "bucket", "rn", "tie")
    source = col("source")
    sized = docs.withColumns({null: source.isNull(), name: F.coalesce(source.cast("string"), F.lit("")), size: n_words(col("text")), tie: F.xxhash64(col("text"))})
    sums = sized.groupBy(F.col(null).alias("is_null"), F.col(name).alias("name")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("rows"))
    plan = targets(sums).select(
        F.col("is_null").alias(null), F.col("name").alias(name),
        F.struct(
            F.col("size").alias("source_size"), "target", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate"),
            F.ceil(F.col("rows") / bucket_rows).alias("buckets"),
            (F.pmod(F.xxhash64("name", "is_null", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)).alias("offset"),
        ).alias(m),
    )
    # size classes 2^(1/4) apart: taken words stay near the target whichever documents a boundary hits
    placed = sized.join(plan, [null, name]).withColumns({
        group: F.floor(4 * F.log2(F.lit(1.0) + F.col(size))),
        bucket: F.pmod(F.xxhash64(col("doc_id"), F.col(size), F.lit(seed)), F.col(m)["buckets"]),
    })
    keys = [null, name, group, bucket]
    ahead = Window.partitionBy(null, name).orderBy(F.col(group).desc(), bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(rn + "_start"))
    numbered = placed.withColumn(rn, F.row_number().over(Window.partitionBy(*keys).orderBy(col("doc_id"), F.col(size), tie)))
    at = F.col(rn + "_start") + F.col(rn)
    rate, offset = F.col(m)["rate"], F.col(m)["offset"]
    copies = (F.floor(rate * at + offset) - F.floor(rate * (at - 1) + offset)).cast("long")
    out = numbered.join(starts, keys).withColumn(m, F.struct(F.col(size).alias("size"), F.col(m)["source_size"], F.col(m)["target"], copies.alias("copies")))
    return out.drop(null, name, size, group, bucket, rn, rn + "_start", tie), m


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, columns unchanged."""
    out, m = mixed(docs)
    return out.withColumn(m, F.explode(F.when(F.col(m)["copies"] > 0, F.sequence(F.lit(1), F.col(m)["copies"].cast("int"))))).drop(m)


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    out, m = mixed(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", F.col(m)["size"].alias("size"), F.col(m)["source_size"].alias("source_size"), F.col(m)["target"].alias("target"),
                      (F.col(m)["size"] * F.col(m)["copies"]).alias("taken"))
