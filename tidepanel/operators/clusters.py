"""Layered clustering: outlier split, spherical k-means, distances, memberships and crisis ownership."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import expr as E
from tidepanel.operators import moments as N
from tidepanel.operators import stats as S
from tidepanel.operators.passes import Span, fold_pass, kmeans, nearest, pooled


def _rows(df: DataFrame, vector: str) -> DataFrame:
    return df.select(F.xxhash64(vector).alias("idx"), F.col(vector).alias("x"))


def unit(vector: str) -> Column:
    return E.scaled(vector, 1.0 / (E.l2_norm(vector) + 1e-12))


def best_centres(df: DataFrame, vector: str, k: int, seeds: Sequence[int] = (0,)) -> np.ndarray:
    """Centres of the seed with the smallest cost."""
    return min(kmeans(_rows(df, vector), {str(s): (Span(), k, s) for s in seeds}).values(), key=lambda found: found[1])[0]


def inertias(df: DataFrame, vector: str, counts: Sequence[int], seeds: Sequence[int] = (0,), normalise: bool = True) -> DataFrame:
    """Smallest cost per number of clusters, all counts and seeds together, on rows scaled to unit length unless told otherwise."""
    rows = _rows(df.select((unit(vector) if normalise else F.col(vector)).alias("x")), "x")
    fits = kmeans(rows, {f"{k}|{s}": (Span(), k, s) for k in counts for s in seeds})
    table = [(k, min(fits[f"{k}|{s}"][1] for s in seeds)) for k in counts]
    return df.sparkSession.createDataFrame(table, "k int, inertia double")


@dataclass
class Layers:
    """An outlier rule and cosine centroids, all sized by the vector length."""

    method: str
    centroids: list[list[float]]
    center: list[float] | None = None
    variance: list[float] | None = None
    threshold: float | None = None
    scale: float | None = None
    split: list[list[float]] | None = None
    outlier: int = 0


def _lit(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def mahalanobis(vector: str, center: Column, variance: Column) -> Column:
    """Distance to a centre under a diagonal covariance."""
    parts = F.zip_with(F.zip_with(F.col(vector), center, lambda a, c: (a - c) * (a - c)), variance, lambda s, v: s / v)
    return F.sqrt(E.array_sum(parts))


def diagonal_moments(df: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and sample variance per component."""
    mean, cov, _ = N.covariance_matrix(df, vector)
    return mean.tolist(), np.diag(cov).tolist()


def distance_rule(df: DataFrame, distance: str, share: float) -> tuple[float, float]:
    """Distance quantile that marks outliers and the median absolute deviation of the distances."""
    q = S.exact_quantiles(df, [], distance, [1.0 - share, 0.5], ["threshold", "median"]).first()
    spread = df.select(F.abs(F.col(distance) - q["median"]).alias("_d"))
    mad = S.exact_quantiles(spread, [], "_d", [0.5], ["mad"]).first()["mad"]
    return q["threshold"], mad + 1e-9


def spherical_centroids(df: DataFrame, vector: str, r: int, seeds: Sequence[int]) -> list[list[float]]:
    """k-means on unit vectors; each centroid is the mean of its members in original units."""
    centres = best_centres(df.select(unit(vector).alias("_u")), "_u", r, seeds)

    def members(run: str, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
        hot = np.eye(r)[nearest(x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12), centres)[0]]
        return np.concatenate([hot.sum(axis=0), (hot.T @ x).ravel()])

    sums = fold_pass(_rows(df, vector), members, ["all"])["all"]
    return (sums[r:].reshape(r, -1) / np.maximum(sums[:r], 1.0)[:, None]).tolist()


def fit_layers(df: DataFrame, vector: str, r: int = 5, method: str = "quantile", share: float = 0.15, seeds: Sequence[int] = (0,)) -> Layers:
    """Outliers first, by distance quantile or as the smaller of two clusters; then spherical clusters of the rest."""
    held, df, _ = pooled(df.select(vector))
    if method == "quantile":
        center, variance = diagonal_moments(df, vector)
        variance = [v + 1e-12 for v in variance]
        measured = df.withColumn("_d", mahalanobis(vector, _lit(center), _lit(variance)))
        threshold, scale = distance_rule(measured, "_d", share)
        out = Layers(method, spherical_centroids(measured.where(F.col("_d") < threshold), vector, r, seeds), center, variance, threshold, scale)
    else:
        centres = best_centres(df, vector, 2, seeds)
        sizes = fold_pass(_rows(df, vector), lambda run, idx, x: np.bincount(nearest(x, centres)[0], minlength=2).astype(float), ["all"])["all"]
        outlier, split = int(sizes.argmin()), centres.tolist()
        typical = df.where(E.argmin(distances(vector, split, "euclidean")) != outlier)
        out = Layers(method, spherical_centroids(typical, vector, r, seeds), split=split, outlier=outlier)
    held.unpersist()
    return out


def distances(vector: str, centroids: Sequence[Sequence[float]], metric: str = "cosine") -> Column:
    """Array of distances to a short list of centroids; the list is part of the expression, no join needed."""
    measure = E.cosine_distance if metric == "cosine" else E.euclidean
    return F.array(*[measure(vector, _lit(c)) for c in centroids])


def with_layers(df: DataFrame, vector: str, m: Layers) -> DataFrame:
    """Hard label (0 = outlier, else nearest cosine centroid + 1) and soft probabilities of all regimes."""
    out = df.withColumn("_cos", distances(vector, m.centroids))
    if m.method == "quantile":
        out = out.withColumn("_d", mahalanobis(vector, _lit(m.center), _lit(m.variance)))
        is_outlier = F.col("_d") >= m.threshold
        p0 = 1.0 / (1.0 + F.exp(-(F.col("_d") - m.threshold) / m.scale))
    else:
        out = out.withColumn("_d", distances(vector, m.split, "euclidean"))
        is_outlier = E.argmin("_d") == m.outlier
        p0 = F.get(E.membership("_d"), F.lit(m.outlier))
    out = out.withColumn("label", F.when(is_outlier, F.lit(0)).otherwise(E.argmin("_cos") + 1).cast("long"))
    out = out.withColumn("_p", E.membership("_cos")).withColumn("_p0", F.least(F.greatest(p0, F.lit(0.0)), F.lit(1 - 1e-9)))
    raised = -F.array_max("_p") * F.log2(1.0 - F.col("_p0"))
    full = F.concat(F.array(raised), F.col("_p"))
    out = out.withColumn("p", E.let(full, lambda a: E.let(E.array_sum(a) + 1e-12, lambda t: F.transform(a, lambda v: v / t))))
    return out.drop("_cos", "_d", "_p", "_p0")


def crisis_states(df: DataFrame, vector: str, label: str, key: str, share: float = 0.15) -> DataFrame:
    """Per ``key`` the state that owns most of the rows with the largest full Mahalanobis distance, the lowest on a tie: ``(key, crisis)``."""
    fitted = {name: (mean, np.linalg.pinv(cov + 1e-6 * np.eye(len(cov)))) for name, (mean, cov, _) in N.covariance_matrices(df, vector, key).items()}

    @F.pandas_udf("double")
    def distance(names: pd.Series, x: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=x.index)
        for name, rows in x.groupby(names, sort=False):
            mean, inverse = fitted[name]
            z = np.stack(rows.to_numpy()) - mean
            out[rows.index] = ((z @ inverse) * z).sum(axis=1)
        return out

    scored = df.select(key, label, distance(F.col(key).cast("string"), vector).alias("_q"))
    bounds = S.exact_quantiles(scored, [key], "_q", [1 - share], ["_bound"])
    owners = scored.join(bounds, key).groupBy(key, label).agg(F.sum((F.col("_q") >= F.col("_bound")).cast("long")).alias("_n"))
    return owners.groupBy(key).agg(F.min_by(label, F.struct(-F.col("_n"), F.col(label))).cast("int").alias("crisis"))


def crisis_state(df: DataFrame, vector: str, label: str, share: float = 0.15) -> int:
    """As ``crisis_states`` for one table."""
    return crisis_states(df.withColumn("_model", F.lit("")), vector, label, "_model", share).first()["crisis"]


def outlier_table(df: DataFrame, keys: Sequence[str], distance: str, share: float = 0.15) -> DataFrame:
    """Distance threshold, deviation, mark and logistic probability per row, all inside one plan."""
    q = S.exact_quantiles(df, keys, distance, [1.0 - share, 0.5], ["threshold", "_median"])
    tagged = S.joined(df, q, keys, ["threshold", "_median"])
    spread = tagged.withColumn("_dev", F.abs(F.col(distance) - F.col("_median")))
    mad = S.exact_quantiles(spread, keys, "_dev", [0.5], ["mad"])
    out = S.joined(tagged, mad, keys, ["mad"])
    z = (F.col(distance) - F.col("threshold")) / (F.col("mad") + 1e-9)
    return out.withColumn("is_outlier", F.col(distance) >= F.col("threshold")).withColumn("p_outlier", 1.0 / (1.0 + F.exp(-z))).drop("_median")
