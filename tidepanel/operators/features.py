"""Feature preparation and screening on long tables ``(row, feature, value)``.

The number of features is the width of a table (at most a few thousand); the number of
rows is not bounded, so per-feature statistics are partial aggregations or sketches. Such
statistics have one row per feature, a size the width bounds, and are broadcast: joining
by shuffle would send all rows of a feature to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import ordered as O
from tidepanel.operators import moments as N
from tidepanel.operators import stats as S


def standardise(df: DataFrame, keys: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """Z-scores with the population deviation; a constant feature is only centred."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    scale = F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0))
    return df.join(m, list(keys)).withColumn(out, (F.col(value) - F.col("_mean")) / scale).drop("_mean", "_std")


def mask_outliers(df: DataFrame, keys: Sequence[str], value: str, k: float = 10.0) -> DataFrame:
    """Values farther than ``k`` interquartile ranges from the median become NULL."""
    q = S.exact_quantiles(df, keys, value, [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"])
    far = F.abs(F.col(value) - F.col("_q2")) > k * (F.col("_q3") - F.col("_q1"))
    return df.join(q, list(keys), "left").withColumn(value, F.when(~far, F.col(value))).drop("_q1", "_q2", "_q3")


def prepare(panel: DataFrame, date: str = "month", exclude: Sequence[str] = (), drop_initial: int = 2, k: float = 10.0,
            min_share: float = 0.95, bundle: Sequence[str] = ()) -> DataFrame:
    """From a coded monthly panel to a complete feature table.

    Transform by code, drop excluded series and the first ``drop_initial`` months, mask
    outliers, drop sparse series, interpolate, fill with the median. Input and output are
    long: ``(bundle..., month, series_id, value[, tcode])`` with one row per month and
    series (missing values as NULL rows or absent).
    """
    keys = [*bundle, "series_id"]
    months = panel.select(*bundle, date).distinct()
    order = Window.partitionBy(*bundle, F.lit(0)).orderBy(date)
    months = months.withColumn("position", F.row_number().over(order))
    total = months.groupBy(*bundle).agg(F.count(F.lit(1)).alias("_rows"))

    dated = panel.select(*keys, date, "value", "tcode")
    names = dated.groupBy(*keys).agg(F.max("tcode").alias("tcode")).where(~F.col("series_id").isin(*exclude) if exclude else F.lit(True))
    # every series gets every month of its bundle, generated from the months as one array per bundle
    calendar = months.groupBy(*bundle).agg(F.array_agg(F.struct(date, "position")).alias("_m"))
    grid = S.joined(names, calendar, bundle, ["_m"]).select(*keys, "tcode", F.explode("_m").alias("_c"))
    grid = grid.select(*keys, "tcode", F.col("_c")[date].alias(date), F.col("_c")["position"].alias("position"))
    full = grid.join(dated.drop("tcode"), [*keys, date], "left")

    w = O.by(keys, date)
    coded = full.withColumn("value", O.transform_by_code("value", "tcode", w)).where(F.col("position") > drop_initial)
    masked = coded
    if k is not None:
        q = coded.groupBy(*keys).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
        far = F.abs(F.col("value") - F.col("_q")[1]) > k * (F.col("_q")[2] - F.col("_q")[0])
        masked = coded.join(q, keys).withColumn("value", F.when(~far, F.col("value"))).drop("_q")
    rows = total.withColumn("_need", F.floor(F.lit(min_share) * (F.col("_rows") - drop_initial)))
    series = Window.partitionBy(*keys)
    dense = masked.withColumn("_known", F.count("value").over(series)).withColumn("_median", F.percentile("value", F.lit(0.5)).over(series))
    dense = S.joined(dense, rows, bundle, ["_need"]).where(F.col("_known") >= F.col("_need"))
    filled = dense.withColumn("value", F.coalesce(O.interpolated("value", keys, date), "_median"))
    return filled.where(F.col("value").isNotNull()).select(*keys, date, "value", "tcode")


def point_biserial(df: DataFrame, keys: Sequence[str], value: str, flag: str, min_rows: int = 10, capped: bool = False) -> DataFrame:
    """Absolute t-value of each feature's correlation with a 0/1 flag; zero for too few rows or a constant side.

    A perfect correlation is infinite, or very large with ``capped``.
    """
    known = df.where(F.col(value).isNotNull() & F.col(flag).isNotNull())
    y = F.when(F.col(flag) > 0, 1.0).otherwise(0.0)
    m = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(value, y).alias("_r"), F.stddev_pop(value).alias("_sx"), F.stddev_pop(y).alias("_sy")
    )
    r = F.abs("_r")
    bottom = 1 - r * r
    exact = F.lit(float("inf")) if not capped else r * F.sqrt((F.col("n") - 2) / F.lit(1e-12))
    t = F.when(bottom <= (1e-12 if capped else 0.0), exact).otherwise(r * F.sqrt((F.col("n") - 2) / F.when(bottom > 0, bottom)))
    usable = (F.col("n") >= min_rows) & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    return m.select(*keys, "n", F.when(usable, t).otherwise(0.0).alias("t"))


def screen_size(scores: DataFrame, t: str = "t", keys: Sequence[str] = (), at_least: int = 0) -> DataFrame:
    """Number of features whose t-value exceeds ``sqrt(2 ln N)``."""
    group = Window.partitionBy(*keys)
    bound = F.sqrt(2.0 * F.log(F.count(F.lit(1)).over(group)))
    marked = scores.withColumn("_hit", (F.col(t) > bound).cast("long"))
    return marked.groupBy(*keys).agg(F.greatest(F.sum("_hit"), F.lit(at_least)).alias("k"), F.count(F.lit(1)).alias("n_features"))


def anova_f(df: DataFrame, keys: Sequence[str], value: str, label: str) -> DataFrame:
    """One-way F statistic of every feature against the labels."""
    cells = df.groupBy(*keys, label).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    total = cells.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("_k"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_grand"),
        F.sum(F.col("_n") * F.col("_v")).alias("_within"),
    )
    between = cells.join(total.select(*keys, "_grand"), list(keys)).groupBy(*keys).agg(
        F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_grand"), F.lit(2.0))).alias("_between")
    )
    f = (F.col("_between") / (F.col("_k") - 1)) / F.nullif(F.col("_within") / (F.col("n") - F.col("_k")), F.lit(0.0))
    return total.join(between, list(keys)).select(*keys, F.coalesce(f, F.lit(0.0)).alias("f"))


def mean_rank(df: DataFrame, feature: str, scores: Sequence[str], runs: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the descending ranks (ties averaged) over several scores and runs."""
    ranks = [O.average_rank(c, [*keys, *runs]) for c in scores]
    mixed = ranks[0]
    for c in ranks[1:]:
        mixed = mixed + c
    per_run = df.select(*keys, feature, *runs, (mixed / len(scores)).alias("_rank"))
    return per_run.groupBy(*keys, feature).agg(F.avg("_rank").alias("mean_rank"))


def select_top(ranks: DataFrame, size: DataFrame, feature: str, keys: Sequence[str] = ()) -> DataFrame:
    """First ``k`` features in rank order, ``k`` given by a one-row table per key."""
    w = Window.partitionBy(*keys).orderBy("mean_rank", feature)  # as many rows as features
    limited = S.joined(ranks.withColumn("position", F.row_number().over(w)), size, keys, ["k"])
    return limited.where(F.col("position") <= F.col("k")).select(*keys, feature, "position", "mean_rank")


# ---- principal components ---------------------------------------------------------------------

class Components:
    """Scaler and loadings of a principal component analysis; sized by the features, not the rows."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, loadings: np.ndarray, ratio: np.ndarray, n: int):
        self.mean, self.scale, self.loadings, self.ratio, self.n = mean, scale, loadings, ratio, n

    @property
    def cumulative(self) -> np.ndarray:
        return np.cumsum(self.ratio)

    def scores(self, df: DataFrame, vector: str, out: str = "scores") -> DataFrame:
        return component_scores(df, vector, {"": self}, out=out)


def component_scores(df: DataFrame, vector: str, models: dict[str, Components], key: str | None = None, out: str = "scores") -> DataFrame:
    """``df`` with its component scores, every row under the model of its ``key``: one matrix product per model and Arrow batch."""
    fitted = {name: (m.mean, m.scale, m.loadings.T) for name, m in models.items()}

    @F.pandas_udf("array<double>")
    def project(names: pd.Series, x: pd.Series) -> pd.Series:
        scores = pd.Series([None] * len(x), index=x.index, dtype=object)
        for name, rows in x.groupby(names, sort=False):
            mean, scale, loadings = fitted[name]
            scores[rows.index] = pd.Series(list((np.stack(rows.to_numpy()) - mean) / scale @ loadings), index=rows.index)
        return scores

    return df.withColumn(out, project(F.col(key).cast("string") if key else F.lit(""), F.col(vector)))


def components_of(mean: np.ndarray, cov: np.ndarray, n: int, share: float = 0.95) -> Components:
    """Components of the correlation matrix that explain ``share`` of the variance, each with a positive largest loading."""
    variance = np.diag(cov) * (n - 1) / n
    scale = np.where(variance > 0, np.sqrt(np.maximum(variance, 0)), 1.0)
    corr = cov * (n - 1) / n / np.outer(scale, scale)
    values, vectors = np.linalg.eigh(corr)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    ratio = values / values.sum()
    keep = min(int(np.sum(np.cumsum(ratio) < share)) + 1, len(values))
    top = np.argmax(np.abs(vectors), axis=1)
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), top])[:, None]
    return Components(mean, scale, vectors[:keep], ratio[:keep], n)


def fit_components_by(df: DataFrame, vector: str, key: str | None = None, share: float = 0.95) -> dict[str, Components]:
    """Components of the standardised vectors of every ``key``, whose vectors may differ in length.

    One pass folds the rows of all keys into covariance matrices; eigenvectors are found on the
    driver, whose work depends on the number of features only.
    """
    return {name: components_of(*found, share) for name, found in N.covariance_matrices(df, vector, key).items()}


def fit_components(df: DataFrame, vector: str, share: float = 0.95) -> Components:
    """As ``fit_components_by`` for one table."""
    return fit_components_by(df, vector, share=share)[""]


def loading_table(spark, models: Components | dict[str, Components], names: Sequence[str] | dict[str, Sequence[str]]) -> DataFrame:
    """Loadings in long form, with the explained and cumulative shares as two extra rows per component; keyed by ``config`` for several models."""
    several = isinstance(models, dict)
    rows = []
    for config, model in (models if several else {"": models}).items():
        own = names[config] if several else names
        rows += [(config, f"PC{i + 1}", own[j], float(v)) for i, row in enumerate(model.loadings) for j, v in enumerate(row)]
        rows += [(config, f"PC{i + 1}", "__explained_var_ratio__", float(v)) for i, v in enumerate(model.ratio)]
        rows += [(config, f"PC{i + 1}", "__cum_var_ratio__", float(v)) for i, v in enumerate(model.cumulative)]
    out = spark.createDataFrame(rows, "config string, pc string, feature string, value double")
    return out if several else out.drop("config")


def top_loadings(loadings: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` features with the largest absolute loading per component."""
    w = Window.partitionBy("pc").orderBy(F.abs("value").desc(), "feature")
    plain = loadings.where(~F.startswith("feature", F.lit("__")))
    return plain.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
