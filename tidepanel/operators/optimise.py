"""Weighted tail-risk portfolios: one small optimisation per row, spread over the cluster.

The problems are built relationally (windows, scenario probabilities, radii); a row holds
one whole problem of bounded size, so solving needs no grouping. Each solution can be
scored again in SQL with ``risk.weighted_cvar``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions.expr import array_sum, dot, rounded
from tidepanel.operators import risk as R

EPS = 1e-11


def simplex(a: np.ndarray, b: np.ndarray, c: np.ndarray, basis: np.ndarray, max_steps: int = 5000) -> tuple[np.ndarray, np.ndarray, bool]:
    """Minimise ``c x`` over ``a x = b, x >= 0`` from a feasible basis: solution, multipliers of the rows, success.

    Dense tableau, Bland's rule once progress stalls.
    """
    basis = basis.copy()
    inverse = np.linalg.solve(a[:, basis], np.column_stack([a, b]))
    table, rhs = inverse[:, :-1], np.maximum(inverse[:, -1], 0.0)
    cost = c - c[basis] @ table
    stalled = 0
    solved = False
    for _ in range(max_steps):
        entering = np.flatnonzero(cost < -EPS)
        if not len(entering):
            solved = True
            break
        j = entering[0] if stalled > 20 else entering[np.argmin(cost[entering])]
        column = table[:, j]
        rows = np.flatnonzero(column > EPS)
        if not len(rows):
            break
        ratios = rhs[rows] / column[rows]
        least = ratios.min()
        ties = rows[ratios <= least + 1e-14]
        i = ties[np.argmin(basis[ties])] if stalled > 20 else ties[np.argmax(column[ties])]
        stalled = stalled + 1 if least <= 1e-14 else 0
        pivot = table[i, j]
        table[i] /= pivot
        rhs[i] /= pivot
        factors = table[:, j].copy()
        factors[i] = 0.0
        table -= np.outer(factors, table[i])
        rhs = np.maximum(rhs - factors * rhs[i], 0.0)
        cost = cost - cost[j] * table[i]
        basis[i] = j
    x = np.zeros(a.shape[1])
    x[basis] = np.linalg.solve(a[:, basis], b)
    return x, np.linalg.solve(a[:, basis].T, c[basis]), solved


def _linear(r: np.ndarray, p: np.ndarray, eta: float, theta: float, cap: float, g: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray, np.ndarray, bool]:
    """Tail loss plus ``theta`` times the largest of the linear forms ``g x``; the multipliers are those of scenarios and weights."""
    n, k = r.shape
    m = len(g)
    shift = max(0.0, float(r.max())) + 1.0
    capped = cap < 1.0
    ix, iv, iu, iz = 0, k, k + 1, k + 1 + n
    is_, it = iz + 1, iz + 1 + n
    iw = it + m
    width = iw + (k if capped else 0)
    a = np.zeros((1 + n + m + (k if capped else 0), width))
    b = np.zeros(len(a))
    a[0, :k], b[0] = 1.0, 1.0
    rows = 1 + np.arange(n)
    a[rows, :k], a[rows, iv] = r, 1.0
    a[rows, iu + np.arange(n)], a[rows, is_ + np.arange(n)] = 1.0, -1.0
    b[rows] = shift
    norm_rows = 1 + n + np.arange(m)
    a[norm_rows, :k], a[norm_rows, iz] = -g, 1.0
    a[norm_rows, it + np.arange(m)] = -1.0
    if capped:
        cap_rows = 1 + n + m + np.arange(k)
        a[cap_rows, np.arange(k)], a[cap_rows, iw + np.arange(k)] = 1.0, 1.0
        b[cap_rows] = cap
    c = np.zeros(width)
    c[iv], c[iz] = 1.0, theta / (1.0 - eta)
    c[iu : iu + n] = p / (1.0 - eta)

    filled = int(np.ceil(1.0 / cap - 1e-12)) if capped else 1
    x0 = np.zeros(k)
    x0[:filled] = min(cap, 1.0)
    x0[filled - 1] = 1.0 - x0[: filled - 1].sum()
    worst, steepest = int(np.argmin(r @ x0)), int(np.argmax(g @ x0))
    basis = [*range(ix, filled), iv, iz]
    basis += [is_ + i for i in range(n) if i != worst] + [it + i for i in range(m) if i != steepest]
    if capped:
        basis += [iw + j for j in range(filled - 1, k)]
    sol, dual, ok = simplex(a, b, c, np.array(basis))
    return sol[:k], sol[iv] - shift, sol[iz], dual[rows], g.T @ dual[norm_rows], ok


def _slope(gain: np.ndarray, weight: float, cap: float) -> np.ndarray:
    """``weight x / |x|`` at the allowed portfolio of least ``weight |x| - gain x``.

    It is ``s (gain + level)`` between 0 and the cap, where the level makes the sum one and ``|x| = s weight``;
    ``|x| / s`` falls as ``s`` grows, and ``|x|`` lies between ``1 / sqrt(assets)`` and 1.
    """
    k = len(gain)

    def at(s: float) -> np.ndarray:
        levels = np.sort(np.concatenate([-gain, cap / s - gain]))
        sums = np.clip(s * (gain + levels[:, None]), 0.0, cap).sum(axis=1)
        return np.clip(s * (gain + np.interp(1.0, sums, levels)), 0.0, cap)

    low, high = 1.0 / (np.sqrt(k) * weight), 1.0 / weight
    for _ in range(60):
        s = 0.5 * (low + high)
        low, high = (s, high) if np.linalg.norm(at(s)) > s * weight else (low, s)
    x = at(0.5 * (low + high))
    return weight * x / np.linalg.norm(x)


def _euclidean(r: np.ndarray, p: np.ndarray, eta: float, theta: float, cap: float, gap: float = 1e-9) -> tuple[np.ndarray, float, np.ndarray, np.ndarray, bool]:
    """Tail loss plus ``theta`` times the Euclidean length, by Newton steps along a log barrier."""
    used = p > 0
    everything = len(p)
    r, p = r[used], p[used]
    n, k = r.shape
    most, weight = p / (1.0 - eta), theta / (1.0 - eta)

    def inside(q: np.ndarray) -> np.ndarray:
        # scenario weights within their bounds and of sum one
        q = np.clip(q, 0.0, most)
        return q / q.sum() if q.sum() > 1.0 else q + (most - q) * (1.0 - q.sum()) / max((most - q).sum(), 1e-300)

    def bound(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        d = _slope(r.T @ q, weight, min(cap, 1.0))
        filled = np.clip(1.0 - min(cap, 1.0) * np.arange(k), 0.0, min(cap, 1.0))
        return float(np.sort(d - r.T @ q) @ filled), q, d

    def multipliers(x: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # close to the optimum a slack loses its digits, so the tail's border is solved again: prices of all held assets are equal
        tries = [bound(inside(raw))]
        held = (x > 1e-6) & (x < min(cap, 1.0) - 1e-6)
        # what counts as the border is itself rounded: every reading gives a bound, the best one stands
        for near in (1e-2, 1e-3, 1e-4, 1e-5, 1e-6):
            border = (raw > near * most) & (raw < (1.0 - near) * most)
            if not held.any() or not border.any():
                continue
            q = np.where(border, raw, np.where(raw > 0.5 * most, most, 0.0))
            price = weight * x / np.linalg.norm(x) - r.T @ q
            centred = r[border][:, held] - r[border][:, held].mean(axis=1, keepdims=True)
            rows = np.vstack([np.ones(int(border.sum())), centred.T])
            q[border] += np.linalg.lstsq(rows, np.append(1.0 - q.sum(), price[held] - price[held].mean()), rcond=None)[0]
            tries.append(bound(inside(q)))
        _, q, d = max(tries, key=lambda t: t[0])
        whole = np.zeros(everything)
        whole[used] = q
        return whole, d

    top = min(cap, 1.0) if cap < 1.0 else 2.0
    # rows of the inequality system over (x, v, u): x, cap - x, u, u + r x + v
    lhs = np.zeros((2 * k + 2 * n, k + 1 + n))
    lhs[:k, :k], lhs[k : 2 * k, :k] = np.eye(k), -np.eye(k)
    lhs[2 * k : 2 * k + n, k + 1 :] = np.eye(n)
    lhs[2 * k + n :, :k], lhs[2 * k + n :, k], lhs[2 * k + n :, k + 1 :] = r, 1.0, np.eye(n)
    rhs = np.concatenate([np.zeros(k), np.full(k, top), np.zeros(2 * n)])
    cost = np.concatenate([np.zeros(k), [1.0], p / (1.0 - eta)])
    # directions that keep the sum of the weights: the first weight balances the others
    free = np.vstack([np.concatenate([-np.ones(k - 1), np.zeros(1 + n)]), np.eye(k + n)])
    x0 = np.full(k, 1.0 / k)
    loss = -(r @ x0)
    v0 = float(np.quantile(loss, eta))
    y = np.concatenate([x0, [v0], np.maximum(loss - v0, 0.0) + 0.01])
    if cap * k <= 1.0 + 1e-9:
        # equal weights are the only ones allowed; the worst losses carry the scenario weights
        order = np.argsort(-loss)
        ahead = np.cumsum(most[order]) - most[order]
        raw = np.zeros(n)
        raw[order] = np.clip(1.0 - ahead, 0.0, most[order])
        return x0, float(loss[order][np.flatnonzero(ahead < 1.0)[-1]]), *multipliers(x0, raw), True
    decrease = np.inf

    def value(y: np.ndarray, t: float) -> float:
        slack = lhs @ y + rhs
        return np.inf if slack.min() <= 0 else t * (cost @ y + weight * np.linalg.norm(y[:k])) - np.log(slack).sum()

    t, m = 10.0, len(rhs)
    while True:
        for _ in range(60):
            slack = lhs @ y + rhs
            length = np.linalg.norm(y[:k])
            gradient = t * cost - lhs.T @ (1.0 / slack)
            gradient[:k] += t * weight * y[:k] / length
            hessian = (lhs / slack[:, None] ** 2).T @ lhs
            hessian[:k, :k] += t * weight * (np.eye(k) / length - np.outer(y[:k], y[:k]) / length**3)
            reduced = free.T @ hessian @ free
            balance = 1.0 / np.sqrt(np.diag(reduced))
            step = free @ (balance * np.linalg.solve(reduced * np.outer(balance, balance), -balance * (free.T @ gradient)))
            decrease = -float(gradient @ step)
            if decrease < 1e-9:
                break
            size, here = 1.0, value(y, t)
            while size > 1e-12 and value(y + size * step, t) > here - 0.25 * size * decrease:
                size *= 0.5
            if size <= 1e-12:
                break
            y = y + size * step
        if m / t < gap:
            # a Newton decrement this small bounds the distance to the centre, and with it the gap
            raw = 1.0 / (t * (lhs @ y + rhs)[2 * k + n :])
            return y[:k], float(y[k]), *multipliers(y[:k], raw), bool(np.isfinite(y).all() and decrease < 0.1)
        t *= 20.0


def minimise_tail(r: np.ndarray, p: np.ndarray, eta: float, theta: float, cap: float = 1.0, norm: str = "l1") -> dict:
    """Long-only weights that minimise weighted tail loss plus the robust penalty.

    ``norm="l1"`` penalises the largest weight (a linear programme), ``"l2"`` the Euclidean
    length. ``q`` (scenario weights) and ``d`` (the penalty's slope) prove the optimum: see ``certificates``.
    """
    p = np.clip(np.nan_to_num(p), 0.0, None)
    k = r.shape[1]
    failed = {"ok": False, "x": np.full(k, 1.0 / k)}
    if p.sum() <= 0 or cap * k < 1.0 - 1e-12 or not np.isfinite(r).all():
        return failed
    p = p / p.sum()
    if norm == "l2" and theta > 0:
        x, v, q, d, ok = _euclidean(r, p, eta, theta, cap)
        z = float(np.linalg.norm(x))
    else:
        x, v, z, q, d, ok = _linear(r, p, eta, theta, cap, np.eye(k))
        z = z if norm == "l1" else float(np.linalg.norm(x))
    if not ok:
        return failed
    x = np.clip(x, 0.0, None)
    x = x / x.sum()
    loss = -(r @ x)
    objective = v + float(p @ np.maximum(loss - v, 0.0)) / (1 - eta) + theta * z / (1 - eta)
    return {"ok": True, "x": x, "v": float(v), "z": float(z), "objective": float(objective), "q": q, "d": d}


def optimise(problems: DataFrame, eta: float = 0.95, max_weight: float = 1.0, norm: str = "l1", on_failure: str = "equal_weight", proof: bool = False) -> DataFrame:
    """Solve every row ``(…, r, p, theta)`` and append ``w, var_v, dual_norm, objective, success``.

    An unsolvable row gets equal weights and ``success = false``, or raises with
    ``on_failure="raise"``. With ``proof`` the problem (``r, p``) stays and the multipliers ``q, d``
    are added (NULL where unsolved).
    """
    if norm not in ("l1", "l2"):
        raise ValueError("norm must be 'l1' or 'l2'")
    keep = [f for f in problems.schema.fields if proof or f.name not in ("r", "p")]
    parts = [("w", "x"), ("var_v", "v"), ("dual_norm", "z"), ("objective", "objective"), ("success", "ok")] + [("q", "q"), ("d", "d")] * proof

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {name: [] for name, _ in parts}
            for r, p, theta in zip(batch["r"], batch["p"], batch["theta"]):
                r = np.stack([np.asarray(row, dtype=float) for row in r])
                p = np.asarray(p, dtype=float)
                s = minimise_tail(r, p, eta, float(theta), max_weight, norm)
                if not s["ok"]:
                    if on_failure == "raise":
                        raise RuntimeError("no optimal weights found")
                    loss = -(r @ s["x"])
                    v, z = float(np.quantile(loss, eta)), float(s["x"].max() if norm == "l1" else np.linalg.norm(s["x"]))
                    s |= {"v": v, "z": z, "objective": v + float(p @ np.maximum(loss - v, 0)) / (1 - eta) + theta * z / (1 - eta)}
                for name, key in parts:
                    out[name].append(s.get(key))
            yield batch[[f.name for f in keep]].assign(**out)

    schema = T.StructType([
        *keep, T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("var_v", T.DoubleType()),
        T.StructField("dual_norm", T.DoubleType()), T.StructField("objective", T.DoubleType()), T.StructField("success", T.BooleanType()),
        *[T.StructField(name, T.ArrayType(T.DoubleType())) for name in ("q", "d") if proof],
    ])
    return problems.mapInPandas(task, schema)


def certificates(solved: DataFrame, eta: float = 0.95, max_weight: float = 1.0, norm: str = "l1", slack: float = 1e-9) -> DataFrame:
    """Proof of every solution of ``optimise(proof=True)``: ``primal, dual, gap`` and whether both sides are ``feasible``.

    Scenario weights ``q`` (at most ``p / (1 - eta)``, sum one) and a slope ``d`` (dual norm at most
    ``theta / (1 - eta)``) bound every portfolio from below by ``(d - q r) x``; its least value over
    the allowed weights fills the cheapest assets up to the cap. No solver is asked again.
    """
    price = F.transform(F.sequence(F.lit(0), F.size("d") - 1), lambda j: F.get("d", j) - array_sum(F.zip_with("q", "r", lambda q, row: q * F.get(row, j))))
    filled = F.transform(F.array_sort(price), lambda c, j: c * F.least(F.lit(max_weight), F.greatest(F.lit(0.0), 1 - max_weight * j)))
    share = F.transform("p", lambda p: p / array_sum("p"))
    over = array_sum(F.zip_with("r", share, lambda row, p: p * F.greatest(-dot(row, "w") - F.col("var_v"), F.lit(0.0))))
    length = F.array_max("w") if norm == "l1" else F.sqrt(dot("w", "w"))
    steep = array_sum(F.transform("d", F.abs)) if norm == "l1" else F.sqrt(dot("d", "d"))
    allowed = F.forall("w", lambda w: (w >= -slack) & (w <= max_weight + slack)) & (F.abs(array_sum("w") - 1) <= slack)
    bounded = F.forall(F.zip_with("q", share, lambda q, p: (q >= -slack) & (q <= p / (1 - eta) + slack)), lambda x: x) & (F.abs(array_sum("q") - 1) <= slack)
    out = solved.withColumns({
        "primal": F.col("var_v") + (over + F.col("theta") * length) / (1 - eta), "dual": array_sum(filled),
        "feasible": F.coalesce(allowed & bounded & (steep <= F.col("theta") / (1 - eta) + slack), F.lit(False)),
    })
    return out.withColumn("gap", F.col("primal") - F.col("dual"))


# The four strategies as (regime-weighted scenarios, robust penalty).
STRATEGIES = {"SAA": (False, False), "RS": (True, False), "DR": (False, True), "RSDR": (True, True)}


def problems(
    feed: DataFrame, keys: Sequence[str], window: int, n_states: int | None, gammas: Sequence[float], pi: Column | None = None,
    strategies: Sequence[str] = tuple(STRATEGIES), missing: str = "spread", smoothing: float = 1e-3,
) -> DataFrame:
    """All optimisation problems of a rolling backtest, one row each.

    ``feed(keys…, month, r[, state, p])`` holds one row per month; strategies without a
    penalty do not depend on gamma and appear once, with a NULL gamma. ``pi`` maps the
    window columns to the previous month's regime probabilities (default: its ``p``).
    """
    regimes = any(STRATEGIES[s][0] for s in strategies)
    columns = ["r"] + [c for c in ("state", "p") if c in feed.columns]
    w = R.train_windows(feed, keys, window, columns)
    w = w.withColumn("_n_assets", F.size("r")).withColumn("_equal", F.array_repeat(F.lit(1.0 / window), window))
    if regimes:
        before = F.try_element_at("train", F.lit(-1))
        w = w.withColumn("_matrix", R.smoothed_transitions("train", "state", n_states, smoothing))
        w = w.withColumn("_weights", R.next_regime_weights(pi if pi is not None else before["p"], "_matrix"))
        w = w.withColumn("_scenario", R.scenario_probabilities("train", "state", "_weights", missing))
    specs = []
    for s in strategies:
        by_regime, robust = STRATEGIES[s]
        for gamma in gammas if robust else [None]:
            g = F.lit(gamma).cast("double")
            if not robust:
                theta = F.lit(0.0)
            elif by_regime:
                theta = R.weighted_radius("train", "state", "_weights", g, F.col("_n_assets"), missing)
            else:
                theta = R.radius(g, window, F.col("_n_assets"))
            p = F.col("_scenario") if by_regime else F.col("_equal")
            specs.append(F.struct(F.lit(s).alias("strategy"), g.alias("gamma"), theta.alias("theta"), p.alias("p")))
    extra = ["state"] if "state" in feed.columns else []
    prev = [F.try_element_at("train", F.lit(-1))["state"].alias("prev_state")] if extra else []
    diag = [F.array_max("_weights").alias("regime_weight_max"), "_weights"] if regimes else []
    rows = w.select(*keys, "month", F.col("r").alias("realised"), *[F.col(c).alias("actual_state") for c in extra], *prev, *diag,
                    F.transform("train", lambda t: t["r"]).alias("r"), F.explode(F.array(*specs)).alias("s"))
    tail = [F.col("_weights").alias("regime_weights"), "regime_weight_max"] if regimes else []
    return rows.select(*keys, "month", "realised", *(["actual_state", "prev_state"] if extra else []), *tail, "s.strategy", "s.gamma", "s.theta", "r", "s.p")


def backtest(feed: DataFrame, keys: Sequence[str], window: int, n_states: int | None, gammas: Sequence[float], pi: Column | None = None, eta: float = 0.95,
             max_weight: float = 1.0, norm: str = "l1", strategies: Sequence[str] = tuple(STRATEGIES), missing: str = "spread",
             on_failure: str = "equal_weight", n_tasks: int | None = None, proof: bool = False) -> DataFrame:
    """Weights, diagnostics and realised returns by universe, gamma, month and strategy."""
    todo = problems(feed, keys, window, n_states, gammas, pi, strategies, missing)
    spread = F.xxhash64(*keys, "month", "strategy", F.coalesce("gamma", F.lit(-1.0)))
    # few bytes but much work: a stated number of partitions is not merged again by adaptive execution
    spark = feed.sparkSession
    todo = todo.repartition(n_tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), spread)
    solved = optimise(todo, eta, max_weight, norm, on_failure, proof)
    solved = R.concentration(solved).withColumn("ret", dot("w", "realised"))
    solved = solved.withColumn("loss", -F.col("ret")).withColumn("robust_penalty", F.col("theta") * F.col("dual_norm") / (1 - eta))
    all_gammas = F.array(*[F.lit(float(g)) for g in gammas])
    full = solved.withColumn("gamma", F.explode(F.when(F.col("gamma").isNull(), all_gammas).otherwise(F.array("gamma"))))
    return full.drop("realised")


def backtest_report(results: DataFrame, assets: DataFrame, keys: Sequence[str], single: str | None = None, sharpe: str = "mean") -> DataFrame:
    """Performance of every strategy and benchmark with turnover, best first by tail loss."""
    group = [*keys, "gamma", "strategy"]
    perf = R.performance(results, group, sharpe=sharpe).join(R.turnover(results, group), group, "left")
    months = results.select(*keys, F.lit("x").alias("strategy"), "month", "ret")
    bench = R.with_benchmarks(months, assets, keys, single).where(F.col("strategy") != "x")
    bench_perf = R.performance(bench, [*keys, "strategy"], sharpe=sharpe).withColumn("gamma", F.lit(None).cast("double"))
    out = perf.unionByName(bench_perf, allowMissingColumns=True)
    return out.orderBy(F.col("cvar_loss").asc_nulls_last(), *keys, F.col("gamma").asc_nulls_last(), "strategy")

