"""Classification forests whose trees grow over all rows, the lower parts of every tree side by side in tasks.

Values are cut into at most ``BINS`` bins at quantiles. A node with more than ``LOCAL_ROWS`` rows is split from counts
per bin that all tasks add up; once a node is smaller, one task grows everything below it. As long as the bins of all
rows fit ``SHARED_BYTES``, every task reads them where they are stored, from nodes four times as large, and nothing is dealt out; beyond that
the rows of a node are shuffled to its task.
So no task sends counts for nodes it holds no rows of, and neither rows nor whole trees pass through the
driver, only the nodes above ``LOCAL_ROWS`` rows and one number per tree and feature. Bootstrap weights and the features tried at a node
come from hashes, so a forest does not depend on how the rows are dealt out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.passes import hashed, numbered, stack, task_count
from tidepanel.session import kept

BINS, LOCAL_ROWS, LEAST = 32, 60_000, 3  # bins of a feature, rows a task grows from, rows of a leaf
CELLS, TREES_AT_ONCE, ROWS_AT_ONCE = 200_000, 16, 1_024
SHARED_BYTES, BUNDLE_BYTES, VOTES = 64_000_000, 4_000_000, 8_000_000  # bins every task may read whole, trees that are stored as one row, votes a task holds while it walks
STORED = "tree array<int>, node array<int>, feature array<binary>, cut array<binary>, many array<binary>, kind array<binary>, share array<binary>, gains array<double>"
POISSON = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])


@dataclass
class Binned:
    """Rows ``(idx, bins, label, _o0, …)``, one byte per feature, as ``blocks`` of many rows where all fit ``SHARED_BYTES``, and the upper ends of the bins."""

    rows: DataFrame
    blocks: DataFrame | None  # idx, bins, label
    ends: list[np.ndarray]
    n: int
    classes: int


@dataclass
class Forest:
    """Per tree the nodes above ``LOCAL_ROWS`` rows (``tops``), the parts below them as a table (``STORED``, all of a tree in one partition), and the weighted gains of all features."""

    stored: DataFrame
    tops: list[Part]
    ends: list[np.ndarray]
    classes: int
    gains: np.ndarray  # (trees, features)

    @property
    def parts(self) -> DataFrame:
        """A row per part: tree, node, feature, cut, child, votes."""
        classes = self.classes

        def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(tree, node, *(v.tobytes() for v in (p.feature, p.cut, p.child, p.votes))) for tree, node, p in _unpacked(batch, classes)]
                yield pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "child", "votes"])

        return self.stored.mapInPandas(unpack, "tree int, node int, feature binary, cut binary, child binary, votes binary")

    def importances(self) -> np.ndarray:
        """Weighted gains, every tree's made to add up to one."""
        total = self.gains.sum(axis=1, keepdims=True)
        mean = np.where(total > 0, self.gains / np.where(total > 0, total, 1.0), 0.0).sum(axis=0)
        return mean / mean.sum() if mean.sum() > 0 else mean


@dataclass
class Part:
    """Nodes as arrays: feature (-1: a leaf, -2: goes on in the part of that node's number), last bin that goes left, left child (the right one follows it), class shares."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    votes: np.ndarray


def _packed(parts: list[tuple[int, int, Part, np.ndarray]]) -> pd.DataFrame:
    """Parts as one stored row: features and cuts, and for the leaves only the classes seen there with their shares; children follow from the order of the nodes."""
    out: dict[str, list] = {c: [] for c in ("tree", "node", "feature", "cut", "many", "kind", "share", "gains")}
    for tree, node, p, gains in parts:
        votes = p.votes[p.feature < 0]
        leaf, kind = np.nonzero(votes)
        small = np.min_scalar_type(votes.shape[1])
        out["tree"].append(tree)
        out["node"].append(node)
        for c, v in (("feature", p.feature), ("cut", p.cut), ("many", np.count_nonzero(votes, axis=1).astype(small)), ("kind", kind.astype(small)), ("share", votes[leaf, kind])):
            out[c].append(v.tobytes())
        out["gains"] += gains.tolist()
    return pd.DataFrame({c: [v] for c, v in out.items()})


def _unpacked(stored: pd.DataFrame, classes: int) -> Iterator[tuple[int, int, Part]]:
    """Tree, node and part of everything in stored rows."""
    small = np.min_scalar_type(classes)
    for row in zip(*(stored[c] for c in ("tree", "node", "feature", "cut", "many", "kind", "share"))):
        for tree, node, feature, cut, many, kind, share in zip(*row):
            feature = np.frombuffer(feature, np.int16)
            split = feature >= 0
            votes = np.zeros((len(feature), classes), np.float32)
            votes[np.repeat(np.flatnonzero(~split), np.frombuffer(many, small)), np.frombuffer(kind, small)] = np.frombuffer(share, np.float32)
            yield int(tree), int(node), Part(feature, np.frombuffer(cut, np.uint8), np.where(split, 2 * np.cumsum(split) - 1, -1).astype(np.int32), votes)


def bins_of(x: np.ndarray, ends: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(ends)], axis=1).astype(np.uint8)


def binned(df: DataFrame, vector: str, label: str, orders: Sequence[Column] = ()) -> Binned:
    """Bins of all values; every ends is a value that occurs. Labels are 0, 1, … Rows carry the numbers ``orders`` makes of them."""
    own = [f"_o{i}" for i in range(len(orders))]
    rows = df.select(F.col(vector).alias("x"), F.col(label).cast("double").alias("label"))
    odd = F.col("x").isNull() | F.col("label").isNull() | (F.col("label") < 0) | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    n, top, least, most, wrong = rows.agg(F.count(F.lit(1)), F.max("label"), F.min(F.size("x")), F.max(F.size("x")), F.count_if(odd)).first()
    if not n or wrong or least != most:
        raise ValueError("a forest needs rows, labels from 0 and vectors of one length without missing values")
    marks = [(i + 1) / 256 for i in range(256)]
    cells = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.percentile_approx("v", marks, 10_000).alias("q"))
    ends = [np.empty(0)] * most
    for row in cells.collect():
        values = np.unique(row["q"])
        inner = values[:-1]
        ends[row["j"]] = inner if len(inner) < BINS else np.unique(np.quantile(row["q"], np.arange(1, BINS) / BINS, method="lower"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["h", *own]].assign(bins=[row.tobytes() for row in bins_of(stack(batch["x"]), ends)], label=batch["label"].astype(int))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"idx": [batch["idx"].to_numpy().tobytes()], "bins": [b"".join(batch["bins"])], "label": [batch["label"].to_numpy().tobytes()]})

    hashes = F.xxhash64("x", "label").alias("h"), *[o.alias(c) for o, c in zip(orders, own)]
    small = rows.select("x", "label", *hashes).mapInPandas(cut, "h long, bins binary, label int" + "".join(f", {c} long" for c in own))
    order = numbered(small, "h", "bins", "label").select("idx", "bins", "label", *own).persist()
    fits = n * most <= SHARED_BYTES
    blocks = kept(order.select("idx", "bins", "label").coalesce(task_count(order, n)).mapInPandas(pack, "idx binary, bins binary, label binary")) if fits else None
    return Binned(order, blocks, ends, n, int(top) + 1)


def _weights(idx: np.ndarray, seed: int, tree: int) -> np.ndarray:
    return np.searchsorted(POISSON, hashed(idx, (seed * 1_000_003 + tree) % 2**62), "right")


def _tried(seed: int, tree: int, nodes: np.ndarray, width: int) -> np.ndarray:
    """The features tried at every node, by its number in the whole tree (a hash of its path)."""
    most = int(np.ceil(np.sqrt(width)))
    keys = hashed((nodes[:, None] ^ np.int64(zlib.crc32(f"{seed}|{tree}".encode()) << 20)) + np.arange(width, dtype=np.int64)[None, :] * 1_000_003, seed)
    return np.argsort(keys, axis=1)[:, :most]


def _children(nodes: np.ndarray) -> np.ndarray:
    """Numbers of both children of every node."""
    with np.errstate(over="ignore"):
        n = nodes.astype(np.uint64)
        return np.stack([n * np.uint64(6364136223846793005) + np.uint64(s) for s in (1442695040888963407, 3935559000370003845)], axis=1).astype(np.int64)


def _counts(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, at: np.ndarray, tried: np.ndarray, classes: int) -> np.ndarray:
    """Weights per node, tried feature, bin and class."""
    nodes, most = tried.shape
    out = np.empty((nodes, most, BINS, classes))
    rows = np.arange(len(at))
    for j in range(most):
        key = (at * BINS + bins[rows, tried[at, j]]) * classes + label
        out[:, j] = np.bincount(key, weight, nodes * BINS * classes).reshape(nodes, BINS, classes)
    return out


def _splits(counts: np.ndarray, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best feature (-1: none), last bin that goes left, and gain times weight of every node. Weights are whole numbers, so sums are exact in any order."""
    nodes, most, _, classes = counts.shape
    left = counts.cumsum(axis=2)
    total, ones = left[:, 0, -1].copy(), np.ones(classes)
    left = left.reshape(nodes, most * BINS, classes)
    n_left, both = left @ ones, (left @ total[:, :, None])[:, :, 0]
    square = np.multiply(left, left, out=left) @ ones
    n, whole = total @ ones, (total * total) @ ones
    n_right = n[:, None] - n_left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = square / n_left + (whole[:, None] - 2 * both + square) / n_right - (whole / n)[:, None]
    gain = np.where((n_left >= LEAST) & (n_right >= LEAST), gain, -1.0)
    best = gain.argmax(axis=1)
    value = gain[np.arange(nodes), best]
    good = value > 1e-9 * n
    j, cut = np.divmod(best, BINS)
    return np.where(good, tried[np.arange(nodes), j], -1), cut, np.where(good, value, 0.0)


def _shares(at: np.ndarray, label: np.ndarray, weight: np.ndarray, nodes: int, classes: int) -> np.ndarray:
    return np.bincount(at * classes + label, weight, nodes * classes).reshape(nodes, classes)


def _grown(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, root: int, seed: int, tree: int, levels: int, classes: int) -> tuple[Part, np.ndarray]:
    """Everything below one node, level by level, and the gain of every feature."""
    width = bins.shape[1]
    feature, cut, child = [], [], []
    votes, gains = [], np.zeros(width)
    names, at, size = np.array([root], np.int64), np.zeros(len(bins), np.int64), 1
    for level in range(levels + 1):
        held = _shares(at, label, weight, len(names), classes)
        n = held.sum(axis=1)
        f, c = np.full(len(names), -1), np.zeros(len(names), np.int64)
        able = np.flatnonzero((n >= 2 * LEAST) & (held.max(axis=1) < n)) if level < levels else np.empty(0, int)
        if len(able):
            order = np.argsort(at, kind="stable")
            begins = np.searchsorted(at[order], np.arange(len(names) + 1))
            most = int(np.ceil(np.sqrt(width)))
            step = max(1, CELLS // (most * BINS * classes))
            for i in range(0, len(able), step):
                some = able[i : i + step]
                rows = order[begins[some[0]] : begins[some[-1] + 1]]
                place = np.searchsorted(some, at[rows])
                inside = some[np.minimum(place, len(some) - 1)] == at[rows]
                rows, place = rows[inside], place[inside]
                tried = _tried(seed, tree, names[some], width)
                f[some], c[some], value = _splits(_counts(bins[rows], label[rows], weight[rows], place, tried, classes), tried)
                np.add.at(gains, f[some][f[some] >= 0], value[f[some] >= 0])
        split = f >= 0
        after = np.cumsum(split) - 1
        feature.append(f)
        cut.append(c)
        child.append(np.where(split, size + 2 * after, -1))
        votes.append(held / np.maximum(n, 1e-300)[:, None])
        if not split.any():
            break
        size += 2 * int(split.sum())
        go = split[at]
        bins, label, weight, at = bins[go], label[go], weight[go], at[go]
        side = bins[np.arange(len(at)), f[at]] > c[at]
        names, at = _children(names[split]).ravel(), 2 * after[at] + side
    return Part(np.concatenate(feature).astype(np.int16), np.concatenate(cut).astype(np.uint8), np.concatenate(child).astype(np.int32), np.concatenate(votes).astype(np.float32)), gains


@dataclass
class _Top:
    """A tree's nodes above ``LOCAL_ROWS`` rows while they are split; ``open`` are the places still to be split."""

    feature: list[int]
    cut: list[int]
    child: list[int]
    names: list[int]
    votes: list[np.ndarray]
    open: list[int]

    def part(self, classes: int) -> Part:
        return Part(np.array(self.feature, np.int16), np.array(self.cut, np.uint8), np.array(self.child, np.int32), np.array(self.votes, np.float32).reshape(-1, classes))


def _walked(part: Part, bins: np.ndarray) -> np.ndarray:
    """The place in a part where every row ends."""
    at = np.zeros(len(bins), np.int64)
    live = np.flatnonzero(part.feature[at] >= 0)
    while len(live):
        here = at[live]
        at[live] = part.child[here] + (bins[live, part.feature[here]] > part.cut[here])
        live = live[part.feature[at[live]] >= 0]
    return at


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), width)


def _local_rows(data: Binned) -> int:
    """Rows a task grows from: more where it reads all of them anyway."""
    return LOCAL_ROWS if data.blocks is None else 4 * LOCAL_ROWS


def _split_tops(data: Binned, tops: list[_Top], gains: np.ndarray, seed: int, depth: int) -> int:
    """Split all nodes too large for a task, one level of all trees a pass; returns the levels that were split."""
    width, classes, level, local = len(data.ends), data.classes, 0, _local_rows(data)
    while level < depth and any(t.open for t in tops):
        todo = [(i, t.part(classes), np.array(t.open), np.array([t.names[k] for k in t.open], np.int64)) for i, t in enumerate(tops) if t.open]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                bins, label, idx = _matrix(batch["bins"], width), batch["label"].to_numpy(), batch["idx"].to_numpy()
                for tree, part, places, names in todo:
                    weight, at = _weights(idx, seed, tree), _walked(part, bins)
                    place = np.minimum(np.searchsorted(places, at), len(places) - 1)
                    use = (places[place] == at) & (weight > 0)
                    v = _counts(bins[use], label[use], weight[use], place[use], _tried(seed, tree, names, width), classes).ravel()
                    sums[tree] = sums[tree] + v if tree in sums else v
            for tree, v in sums.items():
                yield pd.DataFrame({"tree": [tree], "v": [v]})

        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            names = next(names for i, _, _, names in todo if i == tree)
            tried = _tried(seed, tree, names, width)
            counts = np.sum(np.stack(pdf["v"].to_numpy()), axis=0).reshape(len(names), -1, BINS, classes)
            f, c, value = _splits(counts, tried)
            left = counts.cumsum(axis=2)[np.arange(len(names)), (tried == f[:, None]).argmax(axis=1), c]
            return pd.DataFrame({"tree": tree, "k": np.arange(len(names)), "f": f, "c": c, "gain": value, "left": list(left), "whole": list(counts[:, 0].sum(axis=1))})

        found = data.rows.mapInPandas(count, "tree int, v array<double>").groupBy("tree").applyInPandas(split, "tree int, k int, f int, c int, gain double, left array<double>, whole array<double>")
        opened = {i: t.open for i, t in enumerate(tops)}
        for t in tops:
            t.open = []
        for row in found.orderBy("tree", "k").toLocalIterator():
            t, place = tops[row["tree"]], opened[row["tree"]][row["k"]]
            if row["f"] < 0:
                whole = np.array(row["whole"])
                t.feature[place], t.votes[place] = -1, whole / max(whole.sum(), 1e-300)
                continue
            gains[row["tree"], row["f"]] += row["gain"]
            t.feature[place], t.cut[place], t.child[place] = row["f"], row["c"], len(t.feature)
            left = np.array(row["left"])
            for name, side in zip(_children(np.array([t.names[place]], np.int64))[0], (left, np.array(row["whole"]) - left)):
                if side.sum() > local:
                    t.open.append(len(t.feature))
                t.feature.append(-2)
                t.cut.append(0)
                t.child.append(-1)
                t.names.append(int(name))
                t.votes.append(np.zeros(classes))
        level += 1
    return level


def grow(data: Binned, seed: int, trees: int, depth: int) -> Forest:
    """Trees over bootstrap weights, square root of the features tried at a node, Gini impurity, at least ``LEAST`` rows a leaf."""
    width, classes = len(data.ends), data.classes
    gains = np.zeros((trees, width))
    tops = [_Top([-2], [0], [-1], [1], [np.zeros(classes)], [0] if data.n > _local_rows(data) else []) for _ in range(trees)]
    _split_tops(data, tops, gains, seed, depth)
    parts = [t.part(classes) for t in tops]
    grown = _from_blocks if data.blocks is not None else _from_dealt
    stored = kept(grown(data, parts, [t.names for t in tops], seed, depth))
    own = F.get("tree", F.floor(F.col("at") / width).cast("int")).alias("tree")
    sums = stored.select("tree", F.posexplode("gains").alias("at", "g")).groupBy(own, (F.col("at") % width).alias("j")).agg(F.sum("g").alias("g"))
    for row in sums.collect():
        gains[row["tree"], row["j"]] += row["g"]
    return Forest(stored, parts, data.ends, classes, gains)


def _from_blocks(data: Binned, tops: list[Part], names: list[list[int]], seed: int, depth: int) -> DataFrame:
    """Everything below the tops, some trees a task; every task reads the bins of all rows."""
    width, classes, trees, levels = len(data.ends), data.classes, len(tops), [_levels(p) for p in tops]
    spark = data.rows.sparkSession
    tasks = min(trees, 4 * spark.sparkContext.defaultParallelism)

    def lower(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, held = None, []
        for batch in batches:
            task = int(batch["task"].iloc[0]) if len(batch) else task
            held += zip(batch["idx"], batch["bins"], batch["label"])
        if task is None:
            return
        idx, bins, label = (np.frombuffer(b"".join(column), kind) for column, kind in zip(zip(*held), (np.int64, np.uint8, np.int32)))
        held.clear()
        bins, label, out = bins.reshape(-1, width), label.astype(np.int64), []
        for tree in range(task, trees, tasks):
            weight, at = _weights(idx, seed, tree), _walked(tops[tree], bins)
            for node in np.unique(at[(tops[tree].feature[at] == -2) & (weight > 0)]):
                use = (at == node) & (weight > 0)
                out.append((tree, int(node), *_grown(bins[use], label[use], weight[use].astype(float), names[tree][node], seed, tree, depth - int(levels[tree][node]), classes)))
            if sum(p.feature.nbytes + p.votes.nbytes for _, _, p, _ in out) > BUNDLE_BYTES:
                yield _packed(out)
                out = []
        if out:
            yield _packed(out)

    each = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "task").hint("shuffle_replicate_nl")
    return each.crossJoin(data.blocks.coalesce(1)).mapInPandas(lower, STORED)


def _from_dealt(data: Binned, tops: list[Part], names: list[list[int]], seed: int, depth: int) -> DataFrame:
    """Everything below the tops, a node a task; the rows of a node meet there."""
    width, classes, levels = len(data.ends), data.classes, [_levels(p) for p in tops]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins, label, idx = _matrix(batch["bins"], width), batch["label"].to_numpy(), batch["idx"].to_numpy()
            out = []
            for tree, part in enumerate(tops):
                weight, at = _weights(idx, seed, tree), _walked(part, bins)
                for node in np.unique(at[part.feature[at] == -2]):
                    use = (at == node) & (weight > 0)
                    if use.any():
                        out.append((tree, int(node), bins[use].tobytes(), label[use].astype(np.int32).tobytes(), weight[use].astype(np.uint8).tobytes()))
                if out and (tree + 1) % TREES_AT_ONCE == 0:
                    yield pd.DataFrame(out, columns=["tree", "node", "bins", "label", "weight"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["tree", "node", "bins", "label", "weight"])

    def lower(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        joined = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        p, g = _grown(joined("bins", np.uint8).reshape(-1, width), joined("label", np.int32).astype(np.int64), joined("weight", np.uint8).astype(float),
                      names[tree][node], seed, tree, depth - int(levels[tree][node]), classes)
        return _packed([(tree, node, p, g)])

    dealt = data.rows.mapInPandas(deal, "tree int, node int, bins binary, label binary, weight binary")
    grown = dealt.groupBy("tree", "node").applyInPandas(lower, STORED)
    first = F.get("tree", F.lit(0))
    return grown.repartition(first).sortWithinPartitions(first) if any(len(t.feature) > 1 for t in tops) else grown


def _levels(part: Part) -> np.ndarray:
    """How many splits lie above every node."""
    out = np.zeros(len(part.feature), int)
    for place in np.flatnonzero(part.feature >= 0):  # children come after their parents
        out[part.child[place] : part.child[place] + 2] = out[place] + 1
    return out


def _whole(top: Part, lower: dict[int, Part]) -> Part:
    """One tree from its top and the parts below it."""
    feature, cut, child, votes = [top.feature.copy()], [top.cut.copy()], [top.child.copy()], [top.votes.copy()]
    size = len(top.feature)
    for node, p in lower.items():
        move = lambda c, size=size: np.where(c >= 0, c + size - 1, -1)  # noqa: E731  (the part's root takes the node's place)
        moved = move(p.child)
        feature[0][node], cut[0][node], child[0][node], votes[0][node] = p.feature[0], p.cut[0], moved[0], p.votes[0]
        feature.append(p.feature[1:])
        cut.append(p.cut[1:])
        child.append(moved[1:])
        votes.append(p.votes[1:])
        size += len(p.feature) - 1
    out = Part(*(np.concatenate(v) for v in (feature, cut, child, votes)))
    out.feature[out.feature == -2] = -1  # no row of the bootstrap came here: no votes
    return out


def _swapped_votes(tree: Part, bins: np.ndarray, other: np.ndarray, base: np.ndarray, delta: np.ndarray) -> None:
    """Add a tree's votes for every row to ``base``, and to ``delta`` (rows, features, repeats) what changes when one feature is taken from the partner in ``other``, of the same shape.

    Every row walks down once; where a partner's value would turn off for the first time, a walker of that feature and repeat leaves for the other child.
    """
    n, width, repeats = other.shape
    inner, feature, cut, child = tree.feature >= 0, tree.feature.astype(np.int64), tree.cut, tree.child.astype(np.int64)
    mine, others = bins.reshape(-1), other.reshape(-1, repeats)
    left_off = np.zeros((n * width, repeats), bool)
    at, live = np.zeros(n, np.int64), np.arange(n if inner[0] else 0)
    walkers = []
    while len(live):
        here = at.take(live)
        cell, c, first = live * width + feature.take(here), cut.take(here), child.take(here)
        side = mine.take(cell) > c
        turned = (others.take(cell, axis=0) > c[:, None]) != side[:, None]
        turned &= ~left_off.take(cell, axis=0)
        k, r = np.divmod(np.flatnonzero(turned), repeats)
        if len(k):
            left_off[cell[k], r] = True
            walkers.append((cell[k] * repeats + r, first[k] + ~side[k]))
        first += side
        at[live] = first
        live = live[inner.take(first)]
    own = tree.votes.take(at, axis=0)
    base += own
    if walkers:
        key, place = (np.concatenate(v) for v in zip(*walkers))  # of row, feature and repeat
        row, j = np.divmod(key // repeats, width)
        begin, swap = row * width, others.reshape(-1).take(key)
        go = np.flatnonzero(inner.take(place))
        while len(go):
            here = place.take(go)
            f = feature.take(here)
            value = np.where(f == j.take(go), swap.take(go), mine.take(begin.take(go) + f))
            after = child.take(here) + (value > cut.take(here))
            place[go] = after
            go = go[inner.take(after)]
        delta.reshape(-1, delta.shape[-1])[key] += tree.votes.take(place, axis=0) - own.take(row, axis=0)


def swapped_hits(model: Forest, rows: DataFrame, repeats: int, rows_per_group: int = 4_096, n: int | None = None) -> DataFrame:
    """``(feature, repeat, hits, n)``: rows ``(x, partners, label)`` that are still named rightly when one feature is a partner's; feature -1 is the row as it is.

    ``x`` and ``partners`` are vectors or their bins. A group of rows is one block in one task, and all trees are read past it, one
    after the other, from where they are stored; votes are sums of shares, exact in any order. ``n`` is the number of rows, if known.
    """
    ends, classes, tops, width = model.ends, model.classes, model.tops, len(model.ends)
    cells = width * repeats * classes

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = bins_of(stack(batch["x"]), ends)
            partners = np.stack([bins_of(stack(batch["partners"].map(lambda p: p[r])), ends) for r in range(repeats)], axis=1)
            yield pd.DataFrame({"x": [b.tobytes() for b in own], "partners": [[b.tobytes() for b in some] for some in partners], "label": batch["label"].astype(int)})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, other, label = [], [], []
        for batch in batches:
            own += batch["x"].tolist()
            other += (b for some in batch["partners"] for b in some)
            label.append(batch["label"].to_numpy(np.int32))
        if own:
            yield pd.DataFrame({"bins": [b"".join(own)], "other": [b"".join(other)], "label": [np.concatenate(label).tobytes()]})

    open_nodes = [int((t.feature == -2).sum()) for t in tops]

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = None
        waiting: dict[int, dict[int, Part]] = {}
        left = set(range(len(tops)))

        def walk(tree: int) -> None:
            whole = _whole(tops[tree], waiting.pop(tree, {}))
            left.remove(tree)
            for i in range(0, len(bins), ROWS_AT_ONCE):
                some = slice(i, i + ROWS_AT_ONCE)
                _swapped_votes(whole, bins[some], other[some], base[some], delta[some])

        for batch in batches:
            if not len(batch):
                continue
            if bins is None:
                label = np.frombuffer(batch["label"].iloc[0], np.int32)
                bins = np.frombuffer(batch["bins"].iloc[0], np.uint8).reshape(len(label), width)
                other = np.frombuffer(batch["other"].iloc[0], np.uint8).reshape(len(label), repeats, width).transpose(0, 2, 1).copy()
                base, delta = np.zeros((len(label), classes)), np.zeros((len(label), width, repeats, classes))
            for tree, node, part in _unpacked(batch, classes):
                waiting.setdefault(tree, {})[node] = part
                if len(waiting[tree]) == open_nodes[tree]:
                    walk(tree)
        if bins is None:
            return
        for tree in sorted(left):  # ended above ``LOCAL_ROWS`` rows, or no row of the bootstrap came to a part
            walk(tree)
        hits = np.zeros((width, repeats))
        for i in range(0, len(bins), ROWS_AT_ONCE):
            some = slice(i, i + ROWS_AT_ONCE)
            hits += ((base[some, None, None] + delta[some]).argmax(axis=3) == label[some, None, None]).sum(axis=0)
        j, r = np.indices(hits.shape)
        out = pd.DataFrame({"feature": j.ravel(), "repeat": r.ravel(), "hits": hits.ravel().astype(int)})
        yield pd.concat([pd.DataFrame({"feature": [-1], "repeat": [0], "hits": [int((base.argmax(axis=1) == label).sum())]}), out]).assign(n=len(label))

    if not isinstance(rows.schema["x"].dataType, T.BinaryType):
        rows = rows.mapInPandas(cut, "x binary, partners array<binary>, label int")
    n = rows.count() if n is None else n
    groups = max(1, min(rows.sparkSession.sparkContext.defaultParallelism * 2, n // 64), -(-n // min(rows_per_group, max(64, VOTES // cells))))
    blocks = kept(rows.repartition(groups).mapInPandas(pack, "bins binary, other binary, label binary"))
    trees = model.stored.drop("gains")
    none = trees.sparkSession.range(1).select(*[F.array().cast(c.dataType).alias(c.name) for c in trees.schema])  # a block meets one row at least
    met = trees.unionByName(none).coalesce(1).hint("shuffle_replicate_nl").crossJoin(blocks).mapInPandas(meet, "feature long, repeat int, hits long, n long")
    return met.groupBy("feature", "repeat").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
