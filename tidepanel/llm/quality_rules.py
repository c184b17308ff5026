"""Quality rules: fixed rule statistics per document, and an isolation forest over them.

Each tree cuts the box of all documents' statistics at random; a node without sampled
clean rows ends at once, so unlike documents end on short paths. The cut-off of the mean
path is set on all labelled rows.

Cases: a null text has no words and fails the base rule; an empty table gives an empty
table; repeated rows are judged alike; other columns pass through untouched; without
labelled rows of both kinds the forest rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import col, stored

# White space, counted symbols, and the base rule's bounds.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
OTHER_MARKS = b"!?\"'()[]{}=/\\_~^`@+;:"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
N_FEATURES = 9
STATS = ", ".join(f"{c} long" for c in BASE) + ", features array<double>"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by a window of ``window`` words that occurs at least twice, first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    code, width = one, 1
    while width < window:  # exact ranks of ever wider windows, no hashing
        step = width if 2 * width <= window else 1
        tail = code[width:] if step == width else one[width:]
        m = n - width - step + 1
        _, code = np.unique(code[:m] * (int(tail.max()) + 1) + tail[:m], return_inverse=True)
        width += step
    counts = np.bincount(code)
    hit = (counts[code] > 1).astype(np.int64)
    edge = np.zeros(n + 1, np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    return int((np.cumsum(edge[:n]) > 0).sum())


def measure(text: str | None) -> tuple:
    raw = (text or "").encode()
    words = raw.split()  # on bytes: ASCII white space only
    n = len(words)
    if n == 0:
        return (0, 0, 0, 0, 0, [0.0] * N_FEATURES)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    word_chars = len(text) - without(SPACE)
    symbols = without(SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    upper, lower = without(UPPER), without(LOWER)
    short = sum(1 for w in words if len(w) <= 3)
    ratio = lambda x: x / (1.0 + x)
    features = [
        min(np.log1p(n) / 16, 1.0), ratio(word_chars / n / 8), ratio(symbols / n), dup / len(lines), repeat / n,
        upper / max(upper + lower, 1), without(DIGIT) / len(raw), ratio(without(OTHER_MARKS) / n), short / n,
    ]
    return (n, word_chars, symbols, dup, repeat, [float(x) for x in features])


def measured(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Base statistics and features, a row per text; one text at a time leaves the Arrow batch."""
    base, features = np.empty((len(texts), len(BASE)), np.int64), np.empty((len(texts), N_FEATURES))
    for i, text in enumerate(texts):
        *base[i], features[i] = measure(text.as_py())
    return base, features


def rule_statistics(text) -> F.Column:
    def run(texts: pa.Array) -> pa.Array:
        base, features = measured(texts)
        ends = np.arange(len(texts) + 1, dtype=np.int32) * N_FEATURES
        columns = [*map(pa.array, np.ascontiguousarray(base.T)), pa.ListArray.from_arrays(pa.array(ends), pa.array(features.reshape(-1)))]
        return pa.StructArray.from_arrays(columns, names=[*BASE, "features"])

    return F.arrow_udf(run, STATS)(text)


def base_failed(stats):
    """Of a struct column, or of arrays by name."""
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def _c(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n < 3 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow_tree(rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int, depth_limit: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, path) of one tree; leaves have feature -1."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []

    def grow(part: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, at, at, depth + _c(len(part))])
        wide = np.flatnonzero(hi > lo)
        if len(part) and depth < depth_limit and len(wide) and not (len(part) == 1 and depth >= depth_limit // 2):
            f = int(rng.choice(wide))
            cut = float(rng.uniform(lo[f], hi[f]))
            below = part[:, f] < cut
            hi2, lo2 = hi.copy(), lo.copy()
            hi2[f] = lo2[f] = cut
            nodes[at][:2] = [f, cut]
            nodes[at][2] = grow(part[below], lo, hi2, depth + 1)
            nodes[at][3] = grow(part[~below], lo2, hi, depth + 1)
        return at

    grow(rows, low, high, 0)
    return [tuple(n) for n in nodes]


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, ...]]
    size: int
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / usual path), rounded: high means isolated early."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                at = np.where(f < 0, at, np.where(x[rows, np.maximum(f, 0)] < cut[at], left[at], right[at]))
            total += path[at]
        return np.round(2.0 ** (-(total / len(self.trees)) / max(_c(self.size), 1e-9)), 4)

    def score_udf(self):
        @F.pandas_udf("double")
        def score(features: pd.Series) -> pd.Series:
            return pd.Series(self.scores(np.array(features.tolist(), dtype=float).reshape(-1, N_FEATURES)))

        return score

    def keeps_udf(self):
        """Whether the rules keep a text, in one step: its statistics don't leave the Python worker."""

        def keeps(texts: pa.Array) -> pa.Array:
            base, features = measured(texts)
            kept = ~base_failed(dict(zip(BASE, base.T)))
            kept[kept] = self.scores(features[kept]) < self.cut
            return pa.array(kept)

        return F.arrow_udf(keeps, "boolean")


def fit(stats: DataFrame, labels: DataFrame, trees: int = 100, rows_per_tree: int = 256, depth_limit: int = 16,
        clean_weight: float = 20.0, seed: int = 7) -> Forest:
    """Forest and cut-off from ``stats`` (doc_id, s: rule statistics) and ``labels`` (doc_id, quality).

    The forest is grown on a bounded sample, ``trees * rows_per_tree`` rows labelled clean
    that pass the base rule, drawn by hash; its box spans all documents. The cut-off weighs
    a lost clean row ``clean_weight`` times a passed bad one over all labelled rows.
    """
    box = stats.agg(*[g(F.col("s.features")[i]) for g in (F.min, F.max) for i in range(N_FEATURES)]).first()
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where(~base_failed(F.col("s"))).join(marks, "doc_id").select("doc_id", "quality", F.col("s.features").alias("features"))
    clean = known.where("quality = 1").select("features", F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id")
    sample = clean.orderBy("h", "doc_id").limit(trees * rows_per_tree)
    if box[0] is None or not known.where("quality = 0").take(1) or not known.where("quality = 1").take(1):
        return Forest([], rows_per_tree, 2.0)
    low, high = np.array(box[:N_FEATURES], float), np.array(box[N_FEATURES:], float)
    numbered = sample.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("tree", F.pmod(F.xxhash64("h", "n"), F.lit(trees)))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "doc_id", "n"]).head(rows_per_tree)  # the size of a tree's own sample, by the method
        tree = int(rows["tree"].iloc[0])
        out = pd.DataFrame(grow_tree(np.array(rows["features"].tolist()), low, high, seed + tree, depth_limit), columns=["f", "cut", "l", "r", "path"])
        return out.assign(tree=tree, at=range(len(out)))

    grown = numbered.groupBy("tree").applyInPandas(one, "f long, cut double, l long, r long, path double, tree long, at long").toPandas()
    forest = [tuple(g.sort_values("at")[c].to_numpy() for c in ("f", "cut", "l", "r", "path")) for _, g in grown.groupby("tree")]
    model = Forest(forest, rows_per_tree, 2.0)
    counted = known.groupBy(model.score_udf()("features").alias("score"), "quality").count().toPandas()  # at most 10,001 scores
    table = counted.pivot_table(index="score", columns="quality", values="count", fill_value=0).sort_index()
    good, bad = table[1].to_numpy(float), table[0].to_numpy(float)
    # rejecting from position i on: clean rows lost above it, bad rows passed below it
    cost = clean_weight * np.append(good[::-1].cumsum()[::-1], 0.0) / good.sum() + np.append(0.0, bad.cumsum()) / bad.sum()
    i = int(len(cost) - 1 - np.argmin(cost[::-1]))
    edges = np.append(table.index.to_numpy(), 2.0)
    model.cut = float((edges[i] + edges[i - 1]) / 2) if 0 < i < len(edges) - 1 else float(edges[i])
    return model


def statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", rule_statistics("text").alias("s"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the rule statistics, base_failed, kept and the forest's score."""
    stats = stored(statistics(docs))
    model = fit(stats, labels)
    failed = base_failed(F.col("s"))
    return stats.select(
        "doc_id", *[F.col(f"s.{c}").alias(c) for c in BASE], failed.alias("base_failed"), model.score_udf()(F.col("s.features")).alias("score")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("score") < F.lit(model.cut)))


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns unchanged."""
    model = fit(stored(statistics(docs)), labels)
    return docs.where(model.keeps_udf()(col("text")))
