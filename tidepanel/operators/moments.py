"""Centred moments that merge: counts, means and sums of products of deviations.

Sums of squares cancel where values lie far from zero. A summary here holds deviations from its
own means instead. Two summaries merge exactly: the mean moves by the other's share of the rows, and the product of the two
differences is added once, weighted by both counts. Every entry merges by itself, so a summary may
travel in pieces, and batches, tasks and groups of tasks merge in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 256
PIECE = 4_096  # pairs that travel in one array


def centred(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of the known cells per column and the deviations from them, 0 where unknown.

    Deviations are taken from a value of the column first, so a constant column has none at all.
    """
    first = x[known.argmax(axis=0), np.arange(x.shape[1])]
    first = np.where(known.any(axis=0), first, 0.0)
    n = np.maximum(known.sum(axis=0), 1)
    mean = first + np.where(known, x - first, 0.0).sum(axis=0) / n
    return mean, np.where(known, x - mean, 0.0)


# ---- one column at a time: [n, mean..., squares...] ------------------------------------------------

def column_summary(x: np.ndarray) -> np.ndarray:
    """Count, means and sums of squared deviations of complete rows."""
    if not len(x):
        return np.zeros(1 + 2 * x.shape[1])
    mean, z = centred(x, np.ones(x.shape, bool))
    rest = z.sum(axis=0) / len(x)  # what rounding left
    return np.concatenate([[len(x)], mean + rest, (z * z).sum(axis=0) - len(x) * rest * rest])


def merged_columns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not a[0] or not b[0]:
        return b if not a[0] else a
    d = (len(a) - 1) // 2
    n = a[0] + b[0]
    moved = b[1 : d + 1] - a[1 : d + 1]
    squares = a[d + 1 :] + b[d + 1 :] + moved * moved * (a[0] * b[0] / n)
    return np.concatenate([[n], a[1 : d + 1] + moved * (b[0] / n), squares])


def column_stats(v: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and population variances; a column that differs by rounding only has none."""
    d = (len(v) - 1) // 2
    n, mean, squares = v[0], v[1 : d + 1], v[d + 1 :]
    return int(n), mean, np.where(squares > noise(n, mean), squares, 0.0) / max(n, 1.0)


def noise(n: np.ndarray | float, mean: np.ndarray) -> np.ndarray:
    """Squared deviations that rounding alone can make of ``n`` equal values."""
    return n * (4 * np.finfo(float).eps * mean) ** 2


# ---- pairs of columns, complete by pair: six numbers a pair ------------------------------------------

FIELDS = 6  # n, mean of i, mean of j, product, squares of i, squares of j


def pair_summary(x: np.ndarray) -> np.ndarray:
    """``(FIELDS, pairs)`` for the pairs i <= j of the columns of ``x``; a row counts where both cells are finite."""
    known = np.isfinite(x)
    mean, z = centred(np.where(known, x, 0.0), known)
    m = known.astype(float)
    n, s, p, q = m.T @ m, z.T @ m, z.T @ z, (z * z).T @ m
    i, j = np.triu_indices(x.shape[1])
    count, of_i, of_j = n[i, j], s[i, j], s[j, i]
    share = 1.0 / np.maximum(count, 1.0)
    return np.stack([
        count, mean[i] + of_i * share, mean[j] + of_j * share,
        p[i, j] - of_i * of_j * share, q[i, j] - of_i * of_i * share, q[j, i] - of_j * of_j * share,
    ])


def merged_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1.0)
    both = a[0] * share
    di, dj = b[1] - a[1], b[2] - a[2]
    none = a[0] == 0
    return np.stack([
        n, np.where(none, b[1], a[1] + di * share), np.where(none, b[2], a[2] + dj * share),
        a[3] + b[3] + di * dj * both, a[4] + b[4] + di * di * both, a[5] + b[5] + dj * dj * both,
    ])


def rows_of(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)  # missing cells arrive as NaN


def merged_up(parts: DataFrame, keys: str, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> DataFrame:
    """One array ``v`` per key of ``parts`` (keys, v), merged first among a share of the tasks, then among the shares."""
    names = [k.split()[0] for k in keys.split(", ")]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for v in rows["v"]:
            one = np.asarray(v, float).reshape(shape)
            total = one if total is None else merge(total, one)
        return pd.DataFrame({**{k: rows[k][:1] for k in names}, "v": [total.ravel()]})

    schema = f"{keys}, v array<double>"
    shares = parts.withColumn("share", F.spark_partition_id() % SHARDS).groupBy(*names, "share").applyInPandas(fold, schema)
    return shares.groupBy(*names).applyInPandas(fold, schema)


def pair_moments(df: DataFrame, vector: str, run: str | None = None) -> DataFrame:
    """Pairwise-complete summaries of every pair of vector components: run, number of pairs, piece, and the fields of its pairs in ``v``.

    A task folds its rows into one summary per run, and only pieces of summaries are shuffled.
    Runs may have vectors of different lengths.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("run", sort=False):
                new = pair_summary(rows_of(part["x"]))
                sums[name] = merged_pairs(sums[name], new) if name in sums else new
        for name, v in sums.items():
            pieces = range(0, v.shape[1], PIECE)
            yield pd.DataFrame({"run": name, "pairs": v.shape[1], "piece": range(len(pieces)), "v": [v[:, k : k + PIECE].ravel() for k in pieces]})

    rows = df.select((F.col(run).cast("string") if run else F.lit("")).alias("run"), F.col(vector).alias("x")).where("x is not null")
    keys = "run string, pairs int, piece int"
    return merged_up(rows.mapInPandas(fold, f"{keys}, v array<double>"), keys, merged_pairs, (FIELDS, -1))


def correlation_pairs(df: DataFrame, vector: str, run: str | None = None) -> DataFrame:
    """Covariance (``n - 1``) and correlation of every component pair ``i <= j``; NULL for a constant component."""
    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, piece, v, pairs in zip(batch["run"], batch["piece"], batch["v"], batch["pairs"]):
                n, mi, mj, c, qi, qj = np.asarray(v, float).reshape(FIELDS, -1)
                i, j = (k[piece * PIECE : piece * PIECE + len(n)] for k in np.triu_indices(width(pairs)))
                varied = (qi > noise(n, mi)) & (qj > noise(n, mj)) & (n > 1)
                corr = np.where(varied, c / np.sqrt(np.where(varied, qi * qj, 1.0)), np.nan)
                cov = np.where(n > 1, c / np.maximum(n - 1, 1.0), np.nan)
                yield pd.DataFrame({"run": name, "i": i.astype("int32"), "j": j.astype("int32"), "n": n.astype(np.int64), "cov": cov, "corr": corr})

    out = pair_moments(df, vector, run).mapInPandas(expand, "run string, i int, j int, n long, cov double, corr double")
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("run", "i", "j", "n", known("cov"), known("corr"))


def width(pairs: int) -> int:
    """Columns of a triangle with so many pairs i <= j."""
    return int((np.sqrt(8 * pairs + 1) - 1) / 2 + 0.5)


def covariance_matrices(df: DataFrame, vector: str, run: str | None = None) -> dict[str, tuple[np.ndarray, np.ndarray, int]]:
    """Mean vector, sample covariance and row count per run on the driver; their size is the vector length squared."""
    pieces: dict[str, list] = {}
    for row in pair_moments(df, vector, run).collect():
        pieces.setdefault(row["run"], []).append((row["piece"], np.array(row["v"]).reshape(FIELDS, -1)))
    out = {}
    for name, held in pieces.items():
        n, mean, _, c, _, _ = np.concatenate([v for _, v in sorted(held, key=lambda p: p[0])], axis=1)
        d = width(len(n))
        i, j = np.triu_indices(d)
        cov = np.zeros((d, d))
        cov[i, j] = cov[j, i] = c / np.maximum(n - 1, 1.0)
        out[name] = (mean[i == j], cov, int(n[-1]))
    return out


def covariance_matrix(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``covariance_matrices`` for one table."""
    return covariance_matrices(df, vector)[""]
