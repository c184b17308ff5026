"""Gaussian mixtures by expectation maximisation, any number of runs per pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.operators.moments import column_stats, column_summary, merged_columns
from tidepanel.operators.passes import Span, by_config, columns, fold_pass, lloyd, pooled, starting_rows


@dataclass(frozen=True)
class Run:
    """One fit: ``model`` groups restarts, ``seed`` tells them apart."""

    model: str
    k: int
    seed: int = 0
    span: Span = Span()

    @property
    def name(self) -> str:
        return f"{self.model}|{self.seed}"


@dataclass
class Mixture:
    """Weights, means and covariances in standardised units, with the scaler they refer to."""

    model: str
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray  # (k, d, d), or (k, d) variances
    mean: np.ndarray
    scale: np.ndarray
    loglik: float = -np.inf
    n: int = 0
    steps: int = 0
    converged: bool = False
    history: list[float] = field(default_factory=list)
    config: str = ""

    @property
    def middle(self) -> np.ndarray:
        return self.weights @ self.means

    @property
    def diagonal(self) -> bool:
        return self.covs.ndim == 2

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density per row and component; rows in original units."""
        z = (x - self.mean) / self.scale
        k, d = self.means.shape
        out = np.empty((len(z), k))
        for i in range(k):
            diff = z - self.means[i]
            if self.diagonal:
                quad, logdet = (diff**2 / self.covs[i]).sum(axis=1), np.log(self.covs[i]).sum()
            else:
                root = np.linalg.cholesky(self.covs[i])
                quad = (np.linalg.solve(root, diff.T) ** 2).sum(axis=0)
                logdet = 2 * np.log(np.diag(root)).sum()
            out[:, i] = np.log(self.weights[i]) - 0.5 * (quad + logdet + d * np.log(2 * np.pi))
        return out

    def n_parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * (d if self.diagonal else d * (d + 1) // 2)

    def bic(self) -> float:
        return -2 * self.loglik + self.n_parameters() * np.log(max(self.n, 1))

    def aic(self) -> float:
        return -2 * self.loglik + 2 * self.n_parameters()


def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.exp(a - top).sum(axis=axis, keepdims=True)) + top, axis=axis)


def _expected(data: DataFrame, models: dict[str, Mixture], spans: dict[str, Span], n_tasks: int | None = None) -> dict[str, np.ndarray]:
    """Per model the log-likelihood and the responsibilities' sums, means and products, in one pass."""

    def expect(run: str, idx: np.ndarray, x: np.ndarray) -> np.ndarray:
        m = models[run]
        x = x[spans[run].mask(idx)]
        joint = m.log_joint(x)
        norm = log_sum(joint, 1)
        resp = np.exp(joint - norm[:, None])
        z = (x - m.mean) / m.scale - m.middle  # products are taken around the middle of the means, so they do not cancel
        second = resp.T @ (z * z) if m.diagonal else np.einsum("nk,ni,nj->kij", resp, z, z, optimize=True)
        return np.concatenate([[norm.sum()], resp.sum(axis=0), (resp.T @ z).ravel(), second.ravel()])

    return fold_pass(data, expect, sorted(models), n_tasks, spans)


def _maximise(m: Mixture, v: np.ndarray, reg: float) -> None:
    k, d = m.means.shape
    nk = v[1 : k + 1] + 10 * np.finfo(float).eps
    mu = v[k + 1 : k + 1 + k * d].reshape(k, d) / nk[:, None]
    rest = v[k + 1 + k * d :]
    if m.diagonal:
        covs = np.maximum(rest.reshape(k, d) / nk[:, None] - mu**2, 0.0) + reg
    else:
        covs = rest.reshape(k, d, d) / nk[:, None, None] - np.einsum("ki,kj->kij", mu, mu)
        covs = (covs + covs.transpose(0, 2, 1)) / 2 + reg * np.eye(d)
    m.weights, m.means, m.covs, m.steps = nk / nk.sum(), mu + m.middle, covs, m.steps + 1


def step(df: DataFrame, models: dict[str, Mixture], reg: float = 0.0) -> dict[str, Mixture]:
    """One step of expectation maximisation from given parameters, for all models in one pass."""
    out = {name: replace(m, history=[]) for name, m in models.items()}
    for name, v in _expected(columns(df), models, {name: Span(config=m.config) for name, m in models.items()}).items():
        out[name].loglik = float(v[0])
        _maximise(out[name], v, reg)
    return out


def fit(df: DataFrame, runs: Sequence[Run], covariance: str = "full", reg: float = 1e-6, max_iter: int = 100, tol: float = 1e-3,
        standardise: bool = True, warm_steps: int = 8) -> dict[str, Mixture]:
    """Best restart per model on ``df(idx, x[, config])``.

    All unfinished runs share each pass over the persisted rows; a run whose span names a
    configuration looks at that configuration's rows only. A run stops when its mean
    log-likelihood gains less than ``tol``.
    """
    full = covariance == "full"
    held, data, n_tasks = pooled(columns(df))
    by_name = {r.name: r for r in runs}
    spans = {r.name: r.span for r in runs}

    distinct = {}
    for r in runs:
        distinct.setdefault(r.span, r.name)
    sums = fold_pass(data, lambda run, idx, x: column_summary(x[spans[run].mask(idx)]), list(distinct.values()), n_tasks, spans, merged_columns)
    counts, means, variances, scales = {}, {}, {}, {}
    for r in runs:
        counts[r.name], mu, var = column_stats(sums[distinct[r.span]])
        sd = np.sqrt(var)
        variances[r.name] = var
        means[r.name] = mu if standardise else np.zeros(len(mu))
        scales[r.name] = np.where(sd > 0, sd, 1.0) if standardise else np.ones(len(mu))

    starts = starting_rows(data, {r.name: (r.span, r.k, r.seed) for r in runs})
    centres = lloyd(data, starts, spans, warm_steps, n_tasks)
    fits: dict[str, Mixture] = {}
    for r in runs:
        z = (centres[r.name] - means[r.name]) / scales[r.name]
        var = variances[r.name] / scales[r.name] ** 2 + reg
        covs = np.tile(np.diag(var), (r.k, 1, 1)) if full else np.tile(var, (r.k, 1))
        fits[r.name] = Mixture(r.model, np.full(r.k, 1.0 / r.k), z, covs, means[r.name], scales[r.name], n=counts[r.name], config=r.span.config)

    live = set(by_name)
    for _ in range(max_iter):
        if not live:
            break
        for name, v in _expected(data, {name: fits[name] for name in live}, spans, n_tasks).items():
            m = fits[name]
            m.loglik = float(v[0])
            m.history.append(m.loglik)
            if len(m.history) > 1 and abs(m.history[-1] - m.history[-2]) / m.n < tol:
                m.converged = True
                live.discard(name)
            else:
                _maximise(m, v, reg)
    held.unpersist()
    best: dict[str, Mixture] = {}
    for m in fits.values():
        if m.model not in best or m.loglik > best[m.model].loglik:
            best[m.model] = m
    return best


def restarts(model: str, k: int, n_init: int, seed: int = 0, span: Span = Span()) -> list[Run]:
    return [Run(model, k, seed * 1000 + i, span) for i in range(n_init)]


def score(df: DataFrame, models: Sequence[Mixture], spans: dict[str, Span] | None = None, keep: Sequence[str] = ("idx",)) -> DataFrame:
    """Component probabilities, label and log-density of every row under every model (or the rows in its span)."""
    items = {m.model: m for m in models}
    spans = {m.model: (spans or {}).get(m.model, Span(config=m.config)) for m in models}
    keep = list(dict.fromkeys(["idx", *keep]))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby("config", sort=False) if "config" in batch.columns else [("", batch)]:
                for own, idx, x in by_config(rows, list(items), spans):
                    for name in own:
                        inside = np.flatnonzero(spans[name].mask(idx))
                        if not len(inside):
                            continue
                        joint = items[name].log_joint(x[inside])
                        norm = log_sum(joint, 1)
                        p = np.exp(joint - norm[:, None])
                        yield rows.iloc[inside][keep].assign(model=name, label=joint.argmax(axis=1), p=list(p), logp=norm)

    fields = [df.schema[c] for c in keep]
    schema = T.StructType([
        *fields, T.StructField("model", T.StringType()), T.StructField("label", T.LongType()),
        T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("logp", T.DoubleType()),
    ])
    return df.select(*keep, "x", *[c for c in ("config",) if c in df.columns and c not in keep]).mapInPandas(task, schema)


def cross_validate(df: DataFrame, n_rows: int, components: Sequence[int], folds: int = 5, n_init: int = 10, seed: int = 42, max_iter: int = 500) -> DataFrame:
    """Mean held-out log-likelihood per number of components, folds in row order (``idx`` = 0 … n-1).

    The first ``n mod folds`` folds are one row longer. All component counts, folds and
    restarts are one set of runs.
    """
    sizes = [n_rows // folds + (1 if i < n_rows % folds else 0) for i in range(folds)]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    runs, test = [], {}
    for k in components:
        for f in range(folds):
            model = f"{k}|{f}"
            runs += restarts(model, k, n_init, seed, Span(0, n_rows, int(edges[f]), int(edges[f + 1])))
            test[model] = Span(int(edges[f]), int(edges[f + 1]))
    # the caller's rows are standardised once, as one scaler serves all folds
    models = fit(df, runs, max_iter=max_iter, standardise=False)
    held = score(df, list(models.values()), test).groupBy("model").agg(F.avg("logp").alias("fold_score"))
    k = F.split("model", r"\|")[0].cast("int")
    return held.groupBy(k.alias("k")).agg(F.avg("fold_score").alias("score"), F.count(F.lit(1)).alias("folds"))


def choose_components(scores: DataFrame, share: float = 0.20, keys: Sequence[str] = ()) -> DataFrame:
    """Largest count before a marginal gain falls below ``share`` of the total gain; the largest one if none does."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("k")
    whole = Window.partitionBy(*keys)
    total = F.max_by("score", "k").over(whole) - F.min_by("score", "k").over(whole)
    gain = F.col("score") - F.lag("score").over(w)
    marked = scores.withColumn("_total", total).withColumn("_gain", gain).withColumn("_before", F.lag("k").over(w))
    small = F.when((F.col("_total") > 0) & (F.col("_gain") / F.col("_total") < share), F.col("_before"))
    return marked.groupBy(*keys).agg(F.coalesce(F.min(small), F.max("k")).alias("k"))


def elbow_by_curvature(inertias: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Count at the largest second difference of the inertia."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("k")
    bend = F.lead("inertia").over(w) - 2 * F.col("inertia") + F.lag("inertia").over(w)
    bent = inertias.withColumn("_bend", bend)
    best = F.min_by("k", F.when(F.col("_bend").isNotNull(), F.struct(-F.col("_bend"), F.col("k"))))
    return bent.groupBy(*keys).agg(F.coalesce(best, F.min("k")).alias("k"))
