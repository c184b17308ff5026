"""One pass over the data for many model runs at once.

Every iterative model here has the same shape: parameters are a few arrays per run and
live on the driver; a pass folds each task's rows into one array of sufficient statistics
per run; the arrays are added up. Rows never move and nothing is chained from pass to
pass, so a lost executor costs the recomputation of its partitions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.session import kept

SHARDS = 64


@dataclass(frozen=True)
class Span:
    """Rows of a run: ``lo <= idx < hi`` without ``cut_lo <= idx < cut_hi``, of one configuration where the rows name them."""

    lo: int = -(2**63)
    hi: int = 2**63  # beyond every number, hashes included
    cut_lo: int = 0
    cut_hi: int = 0
    config: str = ""

    def mask(self, idx: np.ndarray) -> np.ndarray:
        keep = (idx >= self.lo) & (idx <= self.hi - 1)
        return keep & ~((idx >= self.cut_lo) & (idx < self.cut_hi)) if self.cut_hi > self.cut_lo else keep


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def columns(df: DataFrame) -> DataFrame:
    """What passes read: row number, vector and, where there are several, the configuration."""
    return df.select(*[c for c in ("config", "idx", "x") if c in df.columns])


def by_config(batch: pd.DataFrame, runs: Sequence[str], spans: dict[str, Span] | None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Runs with the rows they look at, one configuration after the other; vectors of a configuration have one length."""
    if "config" not in batch.columns:
        if len(batch):
            yield list(runs), batch["idx"].to_numpy(), stack(batch["x"])
        return
    for config, part in batch.groupby("config", sort=False):
        names = [r for r in runs if spans[r].config == config]
        if names:
            yield names, part["idx"].to_numpy(), stack(part["x"])


def add_up(parts: DataFrame, n_tasks: int | None = None, merge: Merge = np.add) -> dict[str, np.ndarray]:
    """Merge arrays per run (add them, unless told otherwise): first inside ``SHARDS`` groups of tasks, then the few shards on the driver.

    With at most ``SHARDS`` tasks their own arrays are already few enough.
    """

    def shard_sum(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for v in pdf["v"]:
            total = np.asarray(v, float) if total is None else merge(total, np.asarray(v, float))
        return pd.DataFrame({"run": [pdf["run"].iloc[0]], "v": [total]})

    sharded = parts.withColumn("shard", F.spark_partition_id() % SHARDS)
    sums = sharded.groupBy("run", "shard").applyInPandas(shard_sum, "run string, v array<double>")
    if n_tasks is not None and n_tasks <= SHARDS:
        sums = parts
    total: dict[str, np.ndarray] = {}
    for row in sums.collect():
        v = np.array(row["v"])
        total[row["run"]] = merge(total[row["run"]], v) if row["run"] in total else v
    return total


def fold_pass(df: DataFrame, fold: Callable[[str, np.ndarray, np.ndarray], np.ndarray], runs: Sequence[str],
              n_tasks: int | None = None, spans: dict[str, Span] | None = None, merge: Merge = np.add) -> dict[str, np.ndarray]:
    """Merge ``fold(run, idx, x)`` over all batches of ``df(idx, x[, config])``."""
    names = list(runs)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for own, idx, x in by_config(batch, names, spans):
                for run in own:
                    v = fold(run, idx, x)
                    sums[run] = merge(sums[run], v) if run in sums else v
        if sums:
            yield pd.DataFrame({"run": list(sums), "v": list(sums.values())})

    return add_up(columns(df).mapInPandas(task, "run string, v array<double>"), n_tasks, merge)


ROWS_PER_TASK, FEW_ROWS = 50_000, 200


def task_count(df: DataFrame, rows: int, few: int = FEW_ROWS, most: int = ROWS_PER_TASK) -> int:
    """Tasks for a pass over so many rows: all cores if each gets more than a few rows, more if a task would get too many."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // few), -(-rows // most))


def pooled(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame, int]:
    """Persist a table and group its partitions to fit its size.

    Returns the persisted table (to release later), the view to read and the most tasks
    it has. A table that came out of a wide shuffle may have hundreds of near-empty
    partitions, each of which would start a worker on every pass.
    """
    stored = df.persist()
    wanted = task_count(df, stored.count(), most=rows_per_task)
    return stored, stored.coalesce(wanted), wanted


def numbered(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Rows numbered 0 ... n-1 in the given total order, without a window over the table.

    Rows are dealt out by ranges of the order and sorted inside; the counts of the ranges, one number
    each, make their offsets. The dealt rows are kept (in the checkpoint folder, else persisted), so that the
    offsets and the rows speak of the same ranges.
    """
    dealt = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).sortWithinPartitions(*order)
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    held = kept(placed)
    counts = {r["_part"]: r["count"] for r in held.groupBy("_part").count().collect()}
    total, starts = 0, []
    for part in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(part, 0)
    offset = F.get(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), F.col("_part"))
    return held.select(*df.columns, (offset + F.col("_at")).alias(name))


def hashed(idx: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from row numbers and a seed, the same on every executor."""
    with np.errstate(over="ignore"):
        z = idx.astype(np.int64).view(np.uint64) + np.uint64(seed * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return z.astype(np.float64) / 2.0**64


def content(x: np.ndarray) -> np.ndarray:
    """A number per row that depends on its values only."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(x), np.uint64)
        for column in (x + 0.0).T:  # no negative zero
            out = (out ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


def starting_rows(df: DataFrame, runs: dict[str, tuple[Span, int, int]]) -> dict[str, np.ndarray]:
    """``k`` random distinct rows per run ``(span, k, seed)``: those whose content has the smallest hash.

    Equal rows have equal hashes, so a task keeps and sends the first ``k`` different ones of every run,
    however many copies there are, and no second look at the table is needed.
    """
    spans = {r: span for r, (span, _, _) in runs.items()}

    def smallest(rows: pd.DataFrame, k: int) -> pd.DataFrame:
        return rows.sort_values("h", kind="stable").drop_duplicates("h").head(k)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for batch in batches:
            for own, idx, x in by_config(batch, list(runs), spans):
                name = content(x)
                for run in own:
                    span, k, seed = runs[run]
                    keep = np.flatnonzero(span.mask(idx))
                    if not len(keep):
                        continue
                    h = hashed(name[keep], seed)
                    near = np.unique(h, return_index=True)[1][:k]
                    rows = pd.DataFrame({"run": run, "h": h[near], "x": list(x[keep[near]])})
                    held[run] = smallest(pd.concat([held[run], rows]), k) if run in held else rows
        if held:
            yield pd.concat(held.values())

    sent = columns(df).mapInPandas(task, "run string, h double, x array<double>")

    def shard_smallest(rows: pd.DataFrame) -> pd.DataFrame:
        return smallest(rows, runs[rows["run"].iloc[0]][1])[["run", "h", "x"]]

    shards = sent.withColumn("shard", F.spark_partition_id() % SHARDS).groupBy("run", "shard").applyInPandas(shard_smallest, sent.schema)
    rows = shards.groupBy("run").applyInPandas(shard_smallest, sent.schema).toPandas()
    found = {}
    for run, (_, k, _) in runs.items():
        part = rows[rows["run"] == run].sort_values("h")
        if len(part) < k:
            raise ValueError(f"run {run} has fewer than {k} distinct rows")
        found[run] = stack(part["x"])
    return found


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and the squared distance to it, a bounded slice of the rows at a time."""
    label, square = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, 2_000_000 // max(centres.size, 1))
    for i in range(0, len(x), step):
        d = ((x[i : i + step, None, :] - centres[None]) ** 2).sum(axis=2)
        label[i : i + step] = d.argmin(axis=1)
        square[i : i + step] = d.min(axis=1)
    return label, square


def spread_rows(df: DataFrame, runs: dict[str, tuple[Span, int, int]], rounds: int = 3, n_tasks: int | None = None) -> dict[str, np.ndarray]:
    """``k`` starting rows per run ``(span, k, seed)`` by oversampling, for all runs in the same passes.

    Every round draws ``2 k`` further rows, the likelier the farther they lie from those drawn before: each row gets
    an exponential number with its squared distance as rate, the smallest win, and a task keeps and sends
    no more than win. One pass weighs the drawn rows by the rows nearest to them; the few weighted rows are reduced to ``k``.
    """
    spans = {r: span for r, (span, _, _) in runs.items()}
    drawn = starting_rows(df, {r: (span, 1, seed) for r, (span, _, seed) in runs.items()})
    schema = "run string, h double, x array<double>"
    for turn in range(rounds):
        current = dict(drawn)

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[str, pd.DataFrame] = {}
            for batch in batches:
                for own, idx, x in by_config(batch, list(runs), spans):
                    for run in own:
                        span, k, seed = runs[run]
                        inside = np.flatnonzero(span.mask(idx))
                        _, square = nearest(x[inside], current[run])
                        with np.errstate(divide="ignore"):
                            key = -np.log(hashed(idx[inside], 1 + turn + 16 * seed) + 2.0**-65) / square
                        best = np.argsort(key, kind="stable")[: 2 * k]
                        best = best[np.isfinite(key[best])]
                        if not len(best):
                            continue
                        rows = pd.DataFrame({"run": run, "h": key[best], "x": list(x[inside][best])})
                        held[run] = pd.concat([held[run], rows]).nsmallest(2 * k, "h") if run in held else rows
            if held:
                yield pd.concat(held.values())

        def winners(rows: pd.DataFrame) -> pd.DataFrame:
            return rows.nsmallest(2 * runs[rows["run"].iloc[0]][1], "h")[["run", "h", "x"]]

        sent = columns(df).mapInPandas(task, schema)
        shards = sent.withColumn("shard", F.spark_partition_id() % SHARDS).groupBy("run", "shard").applyInPandas(winners, schema)
        for run, rows in shards.groupBy("run").applyInPandas(winners, schema).toPandas().groupby("run"):
            drawn[run] = np.unique(np.vstack([drawn[run], stack(rows["x"])]), axis=0)
    current = dict(drawn)

    def weigh(run: str, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(nearest(x[spans[run].mask(idx)], current[run])[0], minlength=len(current[run])).astype(float)

    weights = fold_pass(df, weigh, list(runs), n_tasks, spans)
    return {run: _reduced(drawn[run], weights[run], k, seed) for run, (_, k, seed) in runs.items()}


def _reduced(rows: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of a few weighted rows, each drawn by weight times squared distance to those before."""
    if len(rows) < k:
        raise ValueError(f"fewer than {k} distinct rows")
    rng = np.random.default_rng(seed)
    taken = [int(rng.choice(len(rows), p=weight / weight.sum()))]
    while len(taken) < k:
        p = np.maximum(weight, 1e-9) * nearest(rows, rows[taken])[1]
        taken.append(int(rng.choice(len(rows), p=p / p.sum())))
    return rows[taken]


def kmeans(df: DataFrame, runs: dict[str, tuple[Span, int, int]], steps: int = 50) -> dict[str, tuple[np.ndarray, float]]:
    """Centres and cost of every run ``(span, k, seed)`` on ``df(idx, x[, config])``: all seeds and counts in the same passes."""
    held, data, n_tasks = pooled(columns(df))
    spans = {r: span for r, (span, _, _) in runs.items()}
    centres = lloyd(data, spread_rows(data, runs, n_tasks=n_tasks), spans, steps, n_tasks, tol=1e-4)
    cost = fold_pass(data, lambda run, idx, x: np.array([nearest(x[spans[run].mask(idx)], centres[run])[1].sum()]), list(runs), n_tasks, spans)
    held.unpersist()
    return {run: (centres[run], float(cost[run][0])) for run in runs}


def lloyd(df: DataFrame, starts: dict[str, np.ndarray], spans: dict[str, Span], steps: int, n_tasks: int | None = None, tol: float = 1e-6) -> dict[str, np.ndarray]:
    """k-means steps for all runs that still move; an empty cluster keeps its centre."""
    centres, live = dict(starts), list(starts)
    for _ in range(steps):
        if not live:
            break
        current = {run: centres[run] for run in live}

        def fold(run: str, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
            c = current[run]
            x = x[spans[run].mask(idx)]
            hot = np.eye(len(c))[nearest(x, c)[0]]
            return np.concatenate([hot.sum(axis=0), (hot.T @ x).ravel() if len(x) else np.zeros(c.size)])

        for run, v in fold_pass(df, fold, live, n_tasks, spans).items():
            k, d = current[run].shape
            n, s = v[:k], v[k:].reshape(k, d)
            centres[run] = np.where(n[:, None] > 0, s / np.maximum(n, 1.0)[:, None], current[run])
        live = [run for run in live if np.abs(centres[run] - current[run]).max() >= tol]
    return centres
