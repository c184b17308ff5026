"""Tree-based feature importance on forests."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import features as J
from tidepanel.operators.forest import Binned, Forest, binned, grow, swapped_hits
from tidepanel.operators.passes import numbered


def _forest(data: Binned, seed: int, trees: int, depth: int) -> Forest:
    return grow(data, seed, trees, depth)


def _forests(data: Binned, seeds: Sequence[int], trees: int, depth: int) -> list[Forest]:
    """One forest per seed, grown side by side."""
    with ThreadPoolExecutor(4) as pool:
        return list(pool.map(lambda seed: _forest(data, seed, trees, depth), seeds))


def _gini(model: Forest, seed: int) -> list[tuple[int, int, float]]:
    return [(int(seed), j, float(v)) for j, v in enumerate(model.importances())]


def forest_importance(df: DataFrame, vector: str, label: str, seeds: Sequence[int] = (0, 1, 2), trees: int = 200, depth: int = 30) -> DataFrame:
    """Impurity importance of every vector component, one forest per seed."""
    data = binned(df, vector, label)
    rows = [row for seed, model in zip(seeds, _forests(data, seeds, trees, depth)) for row in _gini(model, seed)]
    data.rows.unpersist()
    return df.sparkSession.createDataFrame(rows, "seed int, feature long, gini double")


def _order(seed: int, repeat: int) -> Column:
    """The number by which a permutation orders the rows."""
    return F.xxhash64("x", F.lit(seed), F.lit(repeat))


def partnered(df: DataFrame, vector: str, label: str, seed: int, repeats: int) -> DataFrame:
    """Every row with the vectors of the rows that take its place in ``repeats`` permutations: x, partners, label.

    A permutation is a second numbering of the rows, in the order of a hash; it meets the first one on
    the number. It is one permutation of the whole table, whatever the partitions.
    """
    rows = df.select(F.col(vector).alias("x"), F.col(label).cast("double").alias("label"))
    orders = [f"_o{r}" for r in range(repeats)]
    hashed = rows.select("x", "label", *[_order(seed, r).alias(c) for r, c in enumerate(orders)])
    return _paired(numbered(hashed, F.xxhash64("x", "label"), "x", "label"), orders)


def _paired(rows: DataFrame, orders: Sequence[str]) -> DataFrame:
    """x, partners, label of ``rows(idx, x, label)``: a permutation for each column of ``orders``."""
    out = rows.select("idx", "x", "label")
    for r, order in enumerate(orders):
        other = numbered(rows.select(order, "x"), order, "x").select("idx", F.col("x").alias(f"_p{r}"))
        out = out.join(other, "idx")
    return out.select("x", F.array(*[F.col(f"_p{r}") for r in range(len(orders))]).alias("partners"), "label")


def permutation_scores(model: Forest, data: Binned, orders: Sequence[str], seed: int) -> DataFrame:
    """Mean accuracy lost when one component is taken from another row; in every tree only rows whose path turns off are walked again."""
    rows = _paired(data.rows.withColumnRenamed("bins", "x"), orders)
    accuracy = swapped_hits(model, rows, len(orders), n=data.n).select("feature", "repeat", (F.col("hits") / F.col("n")).alias("acc"))
    means = accuracy.groupBy("feature").agg(F.avg("acc").alias("acc"))
    base = F.max(F.when(F.col("feature") == -1, F.col("acc"))).over(J.Window.partitionBy())  # one row per feature
    return means.select("feature", (base - F.col("acc")).alias("drop"), F.lit(seed).alias("seed")).where("feature >= 0")


def permutation_importance(df: DataFrame, vector: str, label: str, seed: int = 0, repeats: int = 3, trees: int = 200, depth: int = 30) -> DataFrame:
    """Mean accuracy lost when one component is permuted over the whole table."""
    data = binned(df, vector, label, [_order(seed, r) for r in range(repeats)])
    scores = permutation_scores(_forest(data, seed, trees, depth), data, [f"_o{r}" for r in range(repeats)], seed)
    data.rows.unpersist()
    return scores


def tree_scores(df: DataFrame, vector: str, label: str, seeds: Sequence[int] = (0, 1, 2), repeats: int = 3, trees: int = 200, depth: int = 30) -> DataFrame:
    """Impurity and permutation importance from one forest per seed: ``(seed, feature, gini, drop)``."""
    data = binned(df, vector, label, [_order(seed, r) for seed in seeds for r in range(repeats)])
    rows, drops = [], None
    for i, (seed, model) in enumerate(zip(seeds, _forests(data, seeds, trees, depth))):
        rows += _gini(model, seed)
        one = permutation_scores(model, data, [f"_o{i * repeats + r}" for r in range(repeats)], seed)
        drops = one if drops is None else drops.unionByName(one)
    data.rows.unpersist()
    return df.sparkSession.createDataFrame(rows, "seed int, feature long, gini double").join(drops, ["seed", "feature"])


def ranked_features(df: DataFrame, long: DataFrame, vector: str = "x", label: str = "label", seeds: Sequence[int] = (0, 1, 2), repeats: int = 3,
                    trees: int = 200, depth: int = 30) -> DataFrame:
    """Mean rank over seeds of impurity, permutation and F importance, best first."""
    f = J.anova_f(long, ["feature"], "value", label)
    joined = tree_scores(df, vector, label, seeds, repeats, trees, depth).join(f, "feature")
    return J.mean_rank(joined, "feature", ["gini", "drop", "f"], runs=["seed"])
