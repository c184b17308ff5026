"""Ordered operators over event sequences of any length.

One sequence may hold a third of all rows, and one day or second of it as many, so nothing here
sorts a whole sequence, or a stretch of time, in one task. Rows are dealt out by ranges of
(sequence, order) of about equal numbers of rows; a range's part of a sequence is a block, sorted on
its own, and the only thing that crosses a block border is one small summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.passes import task_count
from tidepanel.session import kept

BLOCK = "_block"


BLOCK_ROWS, FEW_ROWS = 500_000, 10_000


def with_block(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Number of the range of (keys, order) a row falls in; numbers ascend with the order, and a range is bounded in rows.

    The dealt rows are kept (in the checkpoint folder, else persisted): steps that read them must see the same ranges.
    """
    blocks = blocks or task_count(df, df.count(), FEW_ROWS, BLOCK_ROWS)
    return kept(df.repartitionByRange(blocks, *keys, *order).withColumn(BLOCK, F.spark_partition_id().cast("long")))


def _block_edge(blocks: DataFrame, keys: Sequence[str], payload: Sequence[str], order: Sequence[str], side: str) -> DataFrame:
    """Per block, the neighbouring block's nearest row: the last row before it or the first row after it."""
    pick = F.max_by if side == "before" else F.min_by
    edge = blocks.groupBy(*keys, BLOCK).agg(pick(F.struct(*payload), F.struct(*order)).alias("_edge"))
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    shifted = F.lag("_edge").over(w) if side == "before" else F.lead("_edge").over(w)
    return edge.select(*keys, BLOCK, shifted.alias("_edge"))


def with_neighbour(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, side: str = "before"
) -> DataFrame:
    """The previous (or next) row's value; ``df`` carries a block column from ``with_block``."""
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    inside = (F.lag(value) if side == "before" else F.lead(value)).over(w)
    at_border = (F.lag(F.lit(1)) if side == "before" else F.lead(F.lit(1))).over(w).isNull()
    out = df.withColumn("_inside", inside).withColumn("_border", at_border)
    edges = _block_edge(df, keys, [value], order, side)
    out = out.join(edges, [*keys, BLOCK], "left")
    return out.withColumn(name, F.when(F.col("_border"), F.col("_edge")[value]).otherwise(F.col("_inside"))).drop(
        "_inside", "_border", "_edge"
    )


def transition_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Counts of (state, next state) pairs over all sequences, or per ``by`` columns (a subset of the keys).

    Pairs inside a block are counted where the block is; pairs across a border come from
    the blocks' first and last states alone, so rows are never joined.
    """
    blocked = with_block(df.where(F.col(state).isNotNull()).select(*keys, *order, state), keys, order, blocks)
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    inside = blocked.select(*by, F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state"))
    edges = blocked.groupBy(*keys, BLOCK).agg(
        F.min_by(state, F.struct(*order)).alias("_first"), F.max_by(state, F.struct(*order)).alias("_last")
    )
    next_first = F.lead("_first").over(Window.partitionBy(*keys).orderBy(BLOCK))
    across = edges.select(*by, F.col("_last").alias("from_state"), next_first.alias("to_state"))
    pairs = inside.unionByName(across).where(F.col("to_state").isNotNull())
    return pairs.groupBy(*by, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def periods(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: str, time: str, blocks: int | None = None) -> DataFrame:
    """Contiguous runs of one state: ``start``, ``end`` (first time of the next run, or the run's
    own last time for the final run), ``last_time`` and length.

    Runs are formed inside blocks; a block's count, first and last state decide how its
    runs continue those before it. The rows are shuffled once, the rest works on runs.
    """
    w = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    blocked = with_block(df, keys, order, blocks)
    before = F.lag(state).over(w)
    starts = F.lag(F.lit(1)).over(w).isNull() | ~F.col(state).eqNullSafe(before)
    marked = blocked.withColumn("_new", starts.cast("long"))
    marked = marked.withColumn("_local", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(*keys, BLOCK, "_local").agg(
        F.first(state).alias(state), F.min(time).alias("start"), F.max(time).alias("last_time"), F.count(F.lit(1)).alias("n_rows")
    )
    edges = runs.groupBy(*keys, BLOCK).agg(
        F.count(F.lit(1)).alias("_runs"),
        F.min_by(F.struct(state, "start"), "_local").alias("_first"),
        F.max_by(F.struct(state), "_local").alias("_last"),
    )
    chain = Window.partitionBy(*keys).orderBy(BLOCK)
    joins = F.lag("_last").over(chain)[state].eqNullSafe(F.col("_first")[state]) & F.lag(F.lit(1)).over(chain).isNotNull()
    edges = edges.withColumn("_joins", joins.cast("long")).withColumn("_next", F.lead("_first").over(chain))
    total = lambda c: F.sum(c).over(chain.rowsBetween(Window.unboundedPreceding, 0))
    edges = edges.select(*keys, BLOCK, (total("_runs") - F.col("_runs") - total("_joins")).alias("_base"), F.col("_runs").alias("_last_local"), "_next")

    inner = Window.partitionBy(*keys, BLOCK).orderBy("_local")
    placed = runs.withColumn("_follow", F.lead("start").over(inner)).join(edges, [*keys, BLOCK])
    outside = F.when(~F.col("_next")[state].eqNullSafe(F.col(state)), F.col("_next")["start"])
    follow = F.when(F.col("_local") == F.col("_last_local"), outside).otherwise(F.col("_follow"))
    merged = placed.withColumn("_follow", follow).groupBy(*keys, (F.col("_base") + F.col("_local")).alias("run_id")).agg(
        F.first(state).alias(state), F.min("start").alias("start"), F.max("_follow").alias("_follow"),
        F.max("last_time").alias("last_time"), F.sum("n_rows").alias("n_rows"),
    )
    return merged.select(*keys, "run_id", state, "start", F.coalesce("_follow", "last_time").alias("end"), "last_time", "n_rows")


def last_per_period(df: DataFrame, keys: Sequence[str], period: Column, order: Sequence[str], values: Sequence[str],
                    name: str = "month") -> DataFrame:
    """Last row per key and period by a partial maximum, no sort."""
    best = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*keys, period.alias(name)).agg(best).select(*keys, name, "_last.*")
