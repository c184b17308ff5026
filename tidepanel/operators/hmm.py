"""Hidden Markov models with diagonal Gaussian emissions over many sequences, any number of runs per pass.

A sequence is stored as blocks of at most ``width`` consecutive days, one row per block.
Each pass works on blocks alone: a block is summarised by one small state-to-state matrix per
run, the matrices are chained, and the chained vectors go back to the blocks. Chaining is a tree:
matrices multiply associatively, so neighbouring blocks are multiplied ``FAN`` at a time, level by
level, until one product of a sequence is left, and the vectors come down the same way. However long a
sequence is, a task holds single blocks and at most ``FAN`` matrices a run.
A sequence that fits one block needs no chain: nothing enters it and nothing follows it, so its block is
read where it is stored and nothing is shuffled. Blocks of one batch are padded to the same length and processed together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.mixture import log_sum
from tidepanel.operators.moments import column_stats, column_summary, merged_columns
from tidepanel.operators.passes import Span, add_up, columns, fold_pass, lloyd, pooled, starting_rows, task_count

TINY = 1e-300
CHUNK = 512
FAN = 64


@dataclass(frozen=True)
class Run:
    """One fit: ``model`` groups restarts, ``seed`` tells them apart, ``config`` names the rows where there are several kinds."""

    model: str
    k: int
    seed: int = 0
    config: str = ""

    @property
    def name(self) -> str:
        return f"{self.model}|{self.seed}"


def restarts(model: str, k: int, n_init: int = 1, seed: int = 0, config: str = "") -> list[Run]:
    return [Run(model, k, seed * 100 + i, config) for i in range(n_init)]


@dataclass
class HiddenMarkov:
    means: np.ndarray
    log_vars: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    loglik: float = -np.inf
    n: int = 0
    n_sequences: int = 0
    config: str = ""
    steps: int = 0

    @property
    def k(self) -> int:
        return len(self.start)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Log density ``(..., k)`` of vectors ``(..., d)``."""
        diff = x[..., None, :] - self.means
        d = self.means.shape[1]
        return -0.5 * ((diff**2 * np.exp(-self.log_vars)).sum(axis=-1) + self.log_vars.sum(axis=1) + d * np.log(2 * np.pi))

    def bic(self) -> float:
        k, d = self.means.shape
        return -2 * self.loglik + (2 * k * d + k * (k - 1) + k - 1) * np.log(max(self.n, 1))


def to_blocks(df: DataFrame, seq: str, date: str, x: str, width: int = 64, config: str | None = None) -> DataFrame:
    """Blocks ``(config, seq, block, first, alone, n, dates, x)``: ``n`` ordered rows, at most one per day, their vectors end to end; ``alone`` is a sequence's only one."""
    block = F.floor(F.datediff(date, F.lit("1970-01-01").cast("date")) / width).cast("long")
    kind = F.col(config).cast("string") if config else F.lit("")
    rows = df.groupBy(kind.alias("config"), F.col(seq).alias("seq"), block.alias("block")).agg(
        F.array_sort(F.array_agg(F.struct(F.col(date).alias("date"), F.col(x).alias("x")))).alias("rows")
    )
    whole = Window.partitionBy("config", "seq")
    first, last = F.min("block").over(whole), F.max("block").over(whole)
    return rows.select("config", "seq", "block", (F.col("block") == first).alias("first"), (first == last).alias("alone"), F.size("rows").alias("n"),
                       F.transform("rows", lambda r: r["date"]).alias("dates"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"))


def stored(blocks: DataFrame, blocks_per_task: int = 2_000) -> DataFrame:
    """Blocks persisted by sequence and block, in as many partitions as their number asks for."""
    wanted = task_count(blocks, blocks.count(), 64, blocks_per_task)
    return blocks.repartition(wanted, "config", "seq", "block").persist()


@dataclass(frozen=True)
class Layout:
    """How deep the chain's tree is, how many tasks a pass may have, and whether there are sequences of several blocks and of one."""

    levels: int
    tasks: int
    chained: bool = True
    alone: bool = True


def layout(blocks: DataFrame) -> Layout:
    placed = blocks.select("block", "alone", F.spark_partition_id().alias("part"))
    low, high, parts, chained, alone = placed.agg(F.min("block"), F.max("block"), F.count_distinct("part"), F.max(~F.col("alone")), F.max("alone")).first()
    levels, span = 0, (high - low + 1) if low is not None else 1
    while span > FAN:
        levels, span = levels + 1, span // FAN + 2
    tasks = max(parts, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if chained else parts
    return Layout(levels, tasks, bool(chained), bool(alone))


Models = dict[str, HiddenMarkov]


def _ordered(models: Models) -> dict[str, list[tuple[str, HiddenMarkov]]]:
    """Models by configuration, those with the same number of states next to each other."""
    out: dict[str, list] = {}
    for name, m in sorted(models.items(), key=lambda item: (item[1].k, item[0])):
        out.setdefault(m.config, []).append((name, m))
    return out


def _groups(own: list[tuple[str, HiddenMarkov]]) -> list[tuple[int, int]]:
    """(states, models) of every number of states, in order."""
    sizes = [m.k for _, m in own]
    return [(k, sizes.count(k)) for k in dict.fromkeys(sizes)]


def _padded(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    lengths = batch["n"].to_numpy()
    flat = batch["x"].to_numpy()
    d = len(flat[0]) // int(lengths[0])
    x = np.zeros((len(flat), lengths.max(), d))
    for i, values in enumerate(flat):
        x[i, : lengths[i]] = np.asarray(values, dtype=float).reshape(-1, d)
    return x, lengths


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Configuration and rows, at most CHUNK blocks at once, blocks of like length next to each other."""
    for batch in batches:
        for config, rows in batch.sort_values("n", kind="stable").groupby("config", sort=False):
            for i in range(0, len(rows), CHUNK):
                yield config, rows.iloc[i : i + CHUNK]


def _step_matrices(m: HiddenMarkov, lb: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """Log weights from the previous row's state to this row's; a sequence's first row ignores where it comes from."""
    la = np.broadcast_to(np.log(m.transition + TINY), (len(lb), *m.transition.shape))
    if t == 0:
        la = np.where(first[:, None, None], np.log(m.start + TINY)[None, None, :], la)
    return la + lb[:, t, None, :]


def _summary(m: HiddenMarkov, x: np.ndarray, lengths: np.ndarray, first: np.ndarray, best: bool) -> np.ndarray:
    lb = m.emissions(x)
    total = _step_matrices(m, lb, first, 0)
    for t in range(1, x.shape[1]):
        paths = total[:, :, :, None] + _step_matrices(m, lb, first, t)[:, None, :, :]
        new = paths.max(axis=2) if best else log_sum(paths, 2)
        total = np.where((t < lengths)[:, None, None], new, total)
    return total.reshape(len(total), -1)


def _summaries(blocks: DataFrame, models: Models, best: bool) -> DataFrame:
    """Per block one state-to-state matrix of every model, end to end: sums over paths, or the best path."""
    ordered = _ordered(models)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for config, batch in _chunks(batches):
            if config in ordered:
                x, lengths = _padded(batch)
                first = batch["first"].to_numpy()
                m = np.concatenate([_summary(m, x, lengths, first, best) for _, m in ordered[config]], axis=1)
                yield pd.DataFrame({"config": config, "seq": batch["seq"], "block": batch["block"], "m": list(m)})

    kind = blocks.schema["seq"].dataType.simpleString()
    return blocks.select("config", "seq", "block", "first", "n", "x").mapInPandas(task, f"config string, seq {kind}, block long, m array<double>")


def _sliced(v: np.ndarray, groups: list[tuple[int, int]], power: int) -> list[np.ndarray]:
    """``v`` (..., all models) as arrays (..., models, k[, k]), one per number of states."""
    out, at = [], 0
    for k, r in groups:
        size = r * k**power
        out.append(v[..., at : at + size].reshape(*v.shape[:-1], r, *[k] * power))
        at += size
    return out


def _product(mats: np.ndarray, groups: list[tuple[int, int]], best: bool) -> np.ndarray:
    """One matrix per model for several blocks in a row."""
    out = []
    for group in _sliced(mats, groups, 2):
        total = group[0]
        for one in group[1:]:
            paths = total[:, :, :, None] + one[:, None, :, :]
            total = paths.max(axis=2) if best else log_sum(paths, 2)
        out.append(total.ravel())
    return np.concatenate(out)


def _walk(mats: np.ndarray, groups: list[tuple[int, int]], best: bool, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Per block the vectors that enter it and what follows it, and the models' values of the whole.

    ``enter`` holds the log weight of each state of the row before a block. ``leave`` holds,
    for sums, the log weight of everything after it, for best paths the state the block ends in.
    """
    n = len(mats)
    enters, leaves, totals = [], [], []
    starts = _sliced(enter, groups, 1) if enter is not None else [np.tile(np.where(np.arange(k) == 0, 0.0, -np.inf), (r, 1)) for k, r in groups]
    ends = [None] * len(groups) if leave is None else _sliced(leave, groups, 0 if best else 1)
    for (k, r), group, state, end in zip(groups, _sliced(mats, groups, 2), starts, ends):
        before = np.empty((n + 1, r, k))
        before[0] = state
        for b in range(n):
            paths = before[b][:, :, None] + group[b]
            before[b + 1] = paths.max(axis=1) if best else log_sum(paths, 1)
        enters.append(before[:-1].reshape(n, -1))
        totals.append(before[-1].max(axis=1) if best else log_sum(before[-1], 1))
        if best:
            after = np.empty((n, r))
            after[-1] = before[-1].argmax(axis=1) if end is None else end
            for b in range(n - 1, 0, -1):
                after[b - 1] = (before[b] + group[b][np.arange(r), :, after[b].astype(int)]).argmax(axis=1)
        else:
            after = np.empty((n, r, k))
            after[-1] = 0.0 if end is None else end
            for b in range(n - 1, 0, -1):
                after[b - 1] = log_sum(group[b] + after[b][:, None, :], 2)
        leaves.append(after.reshape(n, -1))
    return np.concatenate(enters, axis=1), np.concatenate(leaves, axis=1), np.concatenate(totals)


def _chain(summaries: DataFrame, models: Models, best: bool, levels: int) -> DataFrame:
    """Per block what ``_walk`` gives over its whole sequence; ``ll`` stands at the sequence's first block."""
    groups = {config: _groups(own) for config, own in _ordered(models).items()}
    kind = summaries.schema["seq"].dataType.simpleString()
    up = F.floor(F.col("block") / FAN).cast("long") if levels else F.lit(0).cast("long")
    rows = summaries.groupBy("config", "seq", up.alias("up")).agg(F.array_sort(F.array_agg(F.struct("block", "m"))).alias("c"))
    rows = rows.select("config", "seq", "up", F.transform("c", lambda c: c["block"]).alias("blocks"), F.transform("c", lambda c: c["m"]).alias("ms"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = [_product(np.stack(ms), groups[config], best) for config, ms in zip(batch["config"], batch["ms"])]
            yield pd.DataFrame({"config": batch["config"], "seq": batch["seq"], "block": batch["up"], "m": m})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            from_above = [(None, None, None)] * len(batch) if not levels else zip(batch["enter"], batch["leave"], batch["ll"])
            for config, seq, ids, ms, (enter, leave, above) in zip(batch["config"], batch["seq"], batch["blocks"], batch["ms"], from_above):
                enters, leaves, total = _walk(np.stack(ms), groups[config], best, enter, leave)
                lls = np.zeros((len(ids), len(total)))
                lls[0] = total if above is None else above
                yield pd.DataFrame({"config": config, "seq": seq, "block": ids, "enter": list(enters), "leave": list(leaves), "ll": list(lls)})

    out = f"config string, seq {kind}, block long, enter array<double>, leave array<double>, ll array<double>"
    if not levels:
        return rows.mapInPandas(walk, out)
    products = rows.mapInPandas(multiply, f"config string, seq {kind}, block long, m array<double>")
    above = _chain(products, models, best, levels - 1).withColumnRenamed("block", "up")
    return rows.join(above, ["config", "seq", "up"]).mapInPandas(walk, out)


def _forward(m: HiddenMarkov, lb: np.ndarray, first: np.ndarray, enter: np.ndarray, best: bool = False) -> np.ndarray:
    out = np.empty_like(lb)
    state = enter
    for t in range(lb.shape[1]):
        paths = state[:, :, None] + _step_matrices(m, lb, first, t)
        state = paths.max(axis=1) if best else log_sum(paths, 1)
        out[:, t] = state
    return out


def _per_model(batch: pd.DataFrame, own: list[tuple[str, HiddenMarkov]], best: bool) -> Iterator[tuple[int, str, HiddenMarkov, np.ndarray, np.ndarray | None]]:
    """Every model with its part of the chained vectors of a batch of blocks; sequences of one block enter from nowhere and have nothing behind them."""
    if "enter" not in batch.columns:
        for i, (name, m) in enumerate(own):
            enter = np.tile(np.where(np.arange(m.k) == 0, 0.0, -np.inf), (len(batch), 1))
            yield i, name, m, enter, None if best else np.zeros((len(batch), m.k))
        return
    enter, leave = np.stack(batch["enter"].to_numpy()), np.stack(batch["leave"].to_numpy())
    at = 0
    for i, (name, m) in enumerate(own):
        part = slice(at, at + m.k)
        yield i, name, m, enter[:, part], leave[:, i].astype(int) if best else leave[:, part]
        at += m.k


def _counts(m: HiddenMarkov, x: np.ndarray, lengths: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Expected starts, transitions and emissions of a batch; emissions are taken around the middle of the means, so that variances do not cancel."""
    k, d = m.means.shape
    lb = m.emissions(x)
    alpha = _forward(m, lb, first, enter)
    beta = np.zeros_like(lb)
    la = np.log(m.transition + TINY)
    for t in range(lb.shape[1] - 1, -1, -1):
        if t + 1 < lb.shape[1]:
            inner = log_sum(la[None] + (lb[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        else:
            inner = leave
        beta[:, t] = np.where((t == lengths - 1)[:, None], leave, inner)
    live = np.arange(lb.shape[1])[None, :] < lengths[:, None]
    joint = alpha + beta
    gamma = np.exp(joint - log_sum(joint, 2)[:, :, None]) * live[:, :, None]
    moves = np.zeros((k, k))
    for t in range(lb.shape[1]):
        use = live[:, t] & ~(first & (t == 0))
        if use.any():
            before = enter if t == 0 else alpha[:, t - 1]
            pair = before[use][:, :, None] + la[None] + (lb[:, t] + beta[:, t])[use][:, None, :]
            pair -= log_sum(pair.reshape(len(pair), -1), 1)[:, None, None]
            moves += np.exp(pair).sum(axis=0)
    flat, g = np.where(live[:, :, None], x - m.means.mean(axis=0), 0.0).reshape(-1, d), gamma.reshape(-1, k)
    return np.concatenate([gamma[:, 0][first].sum(axis=0), moves.ravel(), gamma.sum(axis=(0, 1)), (g.T @ flat).ravel(), (g.T @ flat**2).ravel()])


def _scaled_counts(m: HiddenMarkov, x: np.ndarray, lengths: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None,
                   first: np.ndarray | None = None) -> tuple[float, np.ndarray] | None:
    """Log-likelihood (of whole sequences) and ``_counts`` with probabilities scaled row by row, states before blocks: products of small matrices instead of logarithms.

    What is lost to underflow lies below 1e-308 of the largest; if forward and backward weights of some row meet in less
    than 1e-100, a lost path could have counted, and the caller takes logarithms instead (the result is None).
    """
    k, d = m.means.shape
    n, t_max = x.shape[:2]
    first = np.ones(n, bool) if first is None else first
    moved = m.transition + TINY
    lb = np.ascontiguousarray(m.emissions(x).transpose(1, 2, 0))
    top = lb.max(axis=1)
    e = np.exp(lb - top[:, None])
    live = np.arange(t_max)[:, None] < lengths[None, :]
    behind = np.ones((k, n)) if leave is None else np.exp(leave - leave.max(axis=1, keepdims=True)).T
    prior = np.tile((m.start + TINY)[:, None], (1, n))
    if not first.all():
        entered = np.exp(enter - enter.max(axis=1, keepdims=True)).T
        prior = np.where(first, prior, moved.T @ np.where(first, 1.0, entered))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        alpha, ahead, scale = np.empty_like(e), np.empty_like(e), np.empty((t_max, n))
        for t in range(t_max):
            ahead[t] = moved.T @ alpha[t - 1] if t else prior
            alpha[t] = ahead[t] * e[t]
            scale[t] = alpha[t].sum(axis=0)
            alpha[t] /= scale[t]
        beta = np.empty_like(e)
        for t in range(t_max - 1, -1, -1):
            if t + 1 < t_max:
                beta[t] = moved @ (e[t + 1] * beta[t + 1])
                beta[t] /= beta[t].max(axis=0)
                beta[t] = np.where(t == lengths - 1, behind, beta[t])
            else:
                beta[t] = behind
        gamma = alpha * beta
        met = gamma.sum(axis=1)
        if not (met[live] > 1e-100).all():
            return None
        gamma = np.where(live[:, None], gamma / met[:, None], 0.0)
        weighted = e * beta
        moves = np.zeros((k, k))
        for t in range(t_max):
            use = live[t] & ~first if t == 0 else live[t]
            if use.any():
                before = entered if t == 0 else alpha[t - 1]
                pair = (ahead[t] * weighted[t]).sum(axis=0)
                if not (pair[use] > 1e-100).all():
                    return None
                moves += moved * (np.where(use, before / pair, 0.0) @ np.where(use, weighted[t], 0.0).T)
        loglik = float((np.log(scale) + top)[live].sum())
    flat = np.where(live.T[:, :, None], x - m.means.mean(axis=0), 0.0).transpose(1, 0, 2).reshape(-1, d)
    g = gamma.transpose(0, 2, 1).reshape(-1, k)
    return loglik, np.concatenate([gamma[0][:, first].sum(axis=1), moves.ravel(), g.sum(axis=0), (g.T @ flat).ravel(), (g.T @ flat**2).ravel()])


def _of_block(m: HiddenMarkov, x: np.ndarray, lengths: np.ndarray, first: np.ndarray, enter: np.ndarray, leave: np.ndarray, ll: float | None) -> np.ndarray:
    """Log-likelihood, rows, sequences and expected counts of a batch; ``ll`` is None for whole sequences, which know their own."""
    found = _scaled_counts(m, x, lengths, enter, leave, first)
    if found is None:
        if ll is None:
            alpha = _forward(m, m.emissions(x), first, enter)
            ll = log_sum(alpha[np.arange(len(x)), lengths - 1], 1).sum()
        return np.concatenate([[ll, lengths.sum(), first.sum()], _counts(m, x, lengths, first, enter, leave)])
    return np.concatenate([[found[0] if ll is None else ll, lengths.sum(), first.sum()], found[1]])


def _expected(blocks: DataFrame, models: Models, plan: Layout) -> dict[str, np.ndarray]:
    """Per model the log-likelihood, rows, sequences and expected counts, added up over all blocks in one job."""
    ordered = _ordered(models)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for config, batch in _chunks(batches):
            x, lengths = _padded(batch)
            first = batch["first"].to_numpy()
            ll = np.stack(batch["ll"].to_numpy()).sum(axis=0) if "ll" in batch.columns else None
            for i, name, m, enter, leave in _per_model(batch, ordered[config], False):
                v = _of_block(m, x, lengths, first, enter, leave, None if ll is None else ll[i])
                total[name] = total[name] + v if name in total else v
        if total:
            yield pd.DataFrame({"run": list(total), "v": list(total.values())})

    sums = None
    for part in _parts(blocks, models, False, plan, ["config", "seq", "block", "first", "n", "x"]):
        one = part.mapInPandas(task, "run string, v array<double>")
        sums = one if sums is None else sums.unionByName(one)
    return add_up(sums, plan.tasks)


def _parts(blocks: DataFrame, models: Models, best: bool, plan: Layout, names: Sequence[str]) -> list[DataFrame]:
    """The blocks of sequences of one block as they are, those of longer ones with their chained vectors."""
    out = []
    if plan.alone:
        of_one = blocks.where("alone") if plan.chained else blocks
        out.append(of_one.select(*[c for c in names if c in ("config", "first", "n", "x", "seq", "dates")]))
    if plan.chained:
        longer = blocks.where("not alone")
        out.append(longer.select(*names).join(_chain(_summaries(longer, models, best), models, best, plan.levels), ["config", "seq", "block"]))
    return out or [blocks.select(*names)]


def _maximised(m: HiddenMarkov, e: np.ndarray, reg: float) -> HiddenMarkov:
    k, d = m.means.shape
    begins, moves, mass, first, second = np.split(e[3:], np.cumsum([k, k * k, k, k * d]))
    moves, mass = moves.reshape(k, k), np.maximum(mass, 1e-10)[:, None]
    shift, second = first.reshape(k, d) / mass, second.reshape(k, d) / mass
    variances = np.maximum(second - shift**2, 0.0) + reg
    return HiddenMarkov(m.means.mean(axis=0) + shift, np.log(variances), moves / np.maximum(moves.sum(axis=1, keepdims=True), 1e-10), begins / begins.sum(),
                        float(e[0]), int(e[1]), int(e[2]), m.config, m.steps + 1)


def fit(blocks: DataFrame, rows: DataFrame, runs: Sequence[Run], max_iter: int = 20, tol: float = 1e-3, reg: float = 1e-2, stay: float = 0.95,
        retry: bool = True) -> Models:
    """Baum-Welch, the best restart per model; ``rows(idx, x[, config])`` are the blocks' vectors for the starting means.

    All runs that have not converged share one job a step: restarts, seeds, numbers of states and
    configurations. ``blocks`` should come from ``stored``, so that each pass moves only the
    chained vectors. A model without a finite likelihood is fitted once more with other seeds, then it is an error.
    """
    held, data, n_tasks = pooled(columns(rows))
    spans = {r.name: Span(config=r.config) for r in runs}
    firsts: dict[str, str] = {}
    for r in runs:
        firsts.setdefault(r.config, r.name)
    stats = fold_pass(data, lambda run, idx, x: column_summary(x), list(firsts.values()), n_tasks, spans, merged_columns)
    starts = starting_rows(data, {r.name: (spans[r.name], r.k, r.seed) for r in runs})
    centres = lloyd(data, starts, spans, 10, n_tasks)
    held.unpersist()

    fits: Models = {}
    for r in runs:
        _, _, var = column_stats(stats[firsts[r.config]])
        transition = np.full((r.k, r.k), (1 - stay) / max(1, r.k - 1))
        np.fill_diagonal(transition, stay)
        fits[r.name] = HiddenMarkov(centres[r.name], np.tile(np.log(np.maximum(var, 1e-6) + reg), (r.k, 1)), transition, np.full(r.k, 1.0 / r.k), config=r.config)
    plan, live = layout(blocks), dict(fits)
    for _ in range(max_iter):
        if not live:
            break
        for name, e in _expected(blocks, live, plan).items():
            before = fits[name].loglik
            fits[name] = _maximised(fits[name], e, reg)
            if abs(fits[name].loglik - before) < tol:
                del live[name]
            else:
                live[name] = fits[name]
    best: Models = {}
    for r in runs:
        m = fits[r.name]
        if np.isfinite(m.loglik) and (r.model not in best or m.loglik > best[r.model].loglik):
            best[r.model] = m
    lost = [r for r in runs if r.model not in best]
    if lost and not retry:
        raise ValueError("the likelihood is not finite; check the vectors and raise reg")
    if lost:
        again = [Run(r.model, r.k, r.seed + 50_000, r.config) for r in lost]
        best |= fit(blocks, rows, again, max_iter, tol, reg, stay, retry=False)
    return best


def _applied(blocks: DataFrame, models: HiddenMarkov | Models, best: bool, column: T.StructField, values) -> DataFrame:
    """``(model, seq, date, …)`` under every model; without ``model`` where a single one was given."""
    named = models if isinstance(models, dict) else {"": models}
    ordered = _ordered(named)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for config, batch in _chunks(batches):
            if config not in ordered:
                continue
            x, lengths = _padded(batch)
            first = batch["first"].to_numpy()
            rows = pd.DataFrame({"seq": np.repeat(batch["seq"].to_numpy(), lengths), "date": np.concatenate([np.asarray(v) for v in batch["dates"]])})
            live = np.arange(x.shape[1])[None, :] < lengths[:, None]
            for _, name, m, enter, leave in _per_model(batch, ordered[config], best):
                v = values(m, x, lengths, first, enter, leave)[live]
                yield rows.assign(**{column.name: list(v) if v.ndim == 2 else v, "model": name})

    schema = T.StructType([blocks.schema["seq"], T.StructField("date", T.DateType()), column, T.StructField("model", T.StringType())])
    out = None
    for part in _parts(blocks, named, best, layout(blocks), ["config", "seq", "block", "first", "n", "dates", "x"]):
        one = part.mapInPandas(task, schema)
        out = one if out is None else out.unionByName(one)
    return out.select("model", "seq", "date", column.name) if isinstance(models, dict) else out.drop("model")


def decode(blocks: DataFrame, models: HiddenMarkov | Models) -> DataFrame:
    """Most likely state path ``([model,] seq, date, state)``."""

    def path_of(m, x, lengths, first, enter, leave):
        lb = m.emissions(x)
        score = _forward(m, lb, first, enter, best=True)
        la = np.log(m.transition + TINY)
        state, path = score[np.arange(len(x)), lengths - 1].argmax(axis=1) if leave is None else leave, np.zeros(lb.shape[:2], dtype=int)
        for t in range(lb.shape[1] - 1, -1, -1):
            if t < lb.shape[1] - 1:
                back = (score[:, t] + la[:, state].T).argmax(axis=1)
                state = np.where(t < lengths - 1, back, state)
            path[:, t] = state
        return path

    return _applied(blocks, models, True, T.StructField("state", T.LongType()), path_of)


def filtered(blocks: DataFrame, models: HiddenMarkov | Models) -> DataFrame:
    """State probabilities given the data up to each row, ``([model,] seq, date, p)``."""

    def probabilities(m, x, lengths, first, enter, leave):
        alpha = _forward(m, m.emissions(x), first, enter)
        return np.exp(alpha - log_sum(alpha, 2)[:, :, None])

    return _applied(blocks, models, False, T.StructField("p", T.ArrayType(T.DoubleType())), probabilities)


def numbered_rows(df: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Rows with a stable hash number, the form the starting-point pass reads."""
    return df.select(F.xxhash64(*keys).alias("idx"), F.col(x).alias("x"))
