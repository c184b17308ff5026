"""Portfolio returns, wealth, drawdown, tail risk, scenario weights and performance tables.

Backtest tables hold one row per month and strategy, so a group is bounded by the number
of months in the data; parallelism comes from universes, strategies and parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import ordered as O
from tidepanel.functions.expr import array_sum, dot, let, normalised, ratio


def return_matrix(df: DataFrame, keys: Sequence[str], asset: str = "asset", ret: str = "ret") -> DataFrame:
    """One row per month with the asset returns in alphabetical order; months with a missing asset drop out."""
    known = df.where(F.col(ret).isNotNull())
    width = known.groupBy(*keys).agg(F.count_distinct(asset).alias("n_assets"))
    rows = known.groupBy(*keys, "month").agg(F.array_sort(F.array_agg(F.struct(asset, ret))).alias("_cells"))
    joined = rows.join(width, list(keys)).where(F.size("_cells") == F.col("n_assets"))
    return joined.select(*keys, "month", F.transform("_cells", lambda c: c[ret]).alias("r"))


def asset_names(df: DataFrame, keys: Sequence[str], asset: str = "asset") -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(asset)).alias("assets"))


# ---- wealth and drawdown ----------------------------------------------------------------

def wealth_curve(df: DataFrame, keys: Sequence[str], ret: str = "ret", order: str = "month") -> DataFrame:
    """Cumulative wealth, running peak and drawdown of every return series."""
    w = O.running(O.by(keys, order))
    out = df.where(F.col(ret).isNotNull()).withColumn("wealth", F.product(1 + F.col(ret)).over(w))
    out = out.withColumn("peak", F.max("wealth").over(w))
    return out.withColumn("drawdown", F.col("wealth") / F.nullif(F.col("peak"), F.lit(0.0)) - 1)


def performance(df: DataFrame, keys: Sequence[str], ret: str = "ret", order: str = "month", periods: int = 12,
                eta: float = 0.95, sharpe: str = "mean") -> DataFrame:
    """Return, volatility, Sharpe ratio, VaR, CVaR, drawdown and final wealth per series, in one shuffle.

    ``sharpe="mean"`` divides mean by deviation; ``sharpe="compound"`` divides the annual
    return by the annual volatility.
    """
    curve = wealth_curve(df, keys, ret, order)
    loss = -F.col(ret)
    table = curve.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.max_by("wealth", order).alias("final_wealth"),
        F.stddev_samp(ret).alias("_std"),
        F.avg(ret).alias("_mean"),
        F.percentile(loss, F.lit(eta)).alias("var_loss"),
        F.array_sort(F.array_agg(loss)).alias("_losses"),
        F.min("drawdown").alias("max_drawdown"),
    )
    annual = F.when(F.col("final_wealth") >= 0, F.pow("final_wealth", F.lit(float(periods)) / F.col("n_months")) - 1)
    vol = F.col("_std") * F.sqrt(F.lit(float(periods)))
    table = table.withColumn("ann_return", annual).withColumn("ann_vol", vol)
    if sharpe == "mean":
        ratio_ = F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * F.sqrt(F.lit(float(periods))))
    else:
        ratio_ = F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.col("ann_vol"))
    tail = F.filter("_losses", lambda v: v >= F.col("var_loss"))
    return table.select(
        *keys, "n_months", "ann_return", "ann_vol", ratio_.alias("sharpe"), "var_loss",
        (array_sum(tail) / F.size(tail)).alias("cvar_loss"), "max_drawdown", "final_wealth",
    )


def with_benchmarks(strategies: DataFrame, assets: DataFrame, keys: Sequence[str], single: str | None = None) -> DataFrame:
    """Append the equal-weight mean of all assets, and one named asset, over the strategies' months."""
    months = strategies.select(*keys, "month").distinct()
    inside = assets.join(months, [*keys, "month"], "left_semi")
    equal = inside.groupBy(*keys, "month").agg(F.avg("ret").alias("ret")).withColumn("strategy", F.lit("EQUAL_WEIGHT"))
    out = strategies.select(*keys, "strategy", "month", "ret").unionByName(equal)
    if single:
        one = inside.where(F.col("asset") == single).select(*keys, F.lit("SINGLE_ASSET").alias("strategy"), "month", "ret")
        out = out.unionByName(one)
    return out


def turnover(weights: DataFrame, keys: Sequence[str], order: str = "month", vector: str = "w", skip_first: bool = False) -> DataFrame:
    """Mean and largest sum of absolute weight changes; the first month counts as zero unless skipped."""
    before = F.lag(vector).over(O.by(keys, order))
    moved = array_sum(F.transform(F.zip_with(vector, "_before", lambda a, b: a - b), lambda v: F.abs(v)))
    rows = weights.withColumn("_before", before)
    rows = rows.withColumn("_move", F.when(F.col("_before").isNotNull(), moved) if skip_first else F.when(F.col("_before").isNull(), 0.0).otherwise(moved))
    return rows.groupBy(*keys).agg(F.avg("_move").alias("avg_turnover"), F.max("_move").alias("max_turnover"))


def concentration(weights: DataFrame, vector: str = "w") -> DataFrame:
    """Largest weight, Herfindahl index and effective number of assets."""
    squares = dot(vector, vector)
    return weights.withColumn("max_weight", F.array_max(vector)).withColumn("herfindahl", squares).withColumn(
        "effective_n", ratio(F.lit(1.0), squares)
    )


def regime_conditional(df: DataFrame, keys: Sequence[str], regime: str, ret: str = "ret", periods: int = 12, eta: float = 0.95) -> DataFrame:
    """Performance by strategy and previous regime, with the mean concentration where ``df`` carries ``max_weight`` and ``effective_n``."""
    group = [*keys, regime]
    held = {f"avg_{c}": F.avg(c) for c in ("max_weight", "effective_n") if c in df.columns}
    loss = -F.col(ret)
    table = df.where(F.col(ret).isNotNull() & F.col(regime).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_months"),
        F.product(1 + F.col(ret)).alias("_growth"),
        F.stddev_samp(ret).alias("_std"),
        F.avg(ret).alias("_mean"),
        F.percentile(loss, F.lit(eta)).alias("_var"),
        F.array_sort(F.array_agg(loss)).alias("_losses"),
        F.min(ret).alias("worst_month"),
        F.max(ret).alias("best_month"),
        *[mean.alias(name) for name, mean in held.items()],
    )
    tail = F.filter("_losses", lambda v: v >= F.col("_var"))
    root = F.sqrt(F.lit(float(periods)))
    return table.select(
        *group, "n_months",
        F.when(F.col("_growth") >= 0, F.pow("_growth", F.lit(float(periods)) / F.col("n_months")) - 1).alias("ann_return"),
        (F.col("_std") * root).alias("ann_vol"),
        F.when(F.col("_std") > 0, F.col("_mean") / F.col("_std") * root).alias("sharpe"),
        (array_sum(tail) / F.size(tail)).alias("tail_loss"),
        "worst_month", "best_month", *held,
    )


# ---- rolling train windows and scenario weights -------------------------------------------

def train_windows(df: DataFrame, keys: Sequence[str], n: int, columns: Sequence[str], order: str = "month") -> DataFrame:
    """For every row with ``n`` earlier rows, those rows as one ordered array.

    A bounded frame (``n`` rows) over the months of one universe replaces a self-join.
    """
    w = O.by(keys, order)
    rows = F.array_agg(F.struct(order, *columns)).over(w.rowsBetween(-n, -1))
    out = df.withColumn("train", rows)
    return out.where(F.size("train") == n)


def _train_states(train: str, state: str) -> Column:
    return F.transform(F.col(train), lambda s: s[state].cast("int"))


def _state_counts(states: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.size(F.filter(states, lambda s: s == i)))


def smoothed_transitions(train: str, state: str, k: int, smoothing: float = 1e-3) -> Column:
    """Row-stochastic matrix of the state pairs inside an ordered train array, as an array of rows."""
    grid = F.sequence(F.lit(0), F.lit(k - 1))

    def matrix(states: Column) -> Column:
        steps = F.greatest(F.size(states) - 1, F.lit(0))
        codes = F.zip_with(F.slice(states, 1, steps), F.slice(states, 2, steps), lambda a, b: a * k + b)

        def row(cells: Column, i: Column) -> Column:
            counts = F.transform(grid, lambda j: F.size(F.filter(cells, lambda c: c == i * k + j)) + F.lit(smoothing))
            return let(counts, lambda c: let(array_sum(c), lambda t: F.transform(c, lambda v: v / t)))

        return let(codes, lambda cells: F.transform(grid, lambda i: row(cells, i)))

    return let(_train_states(train, state), matrix)


def next_regime_weights(pi: Column | str, matrix: Column | str) -> Column:
    """``pi`` (scaled to one, uniform if empty) times the transition matrix, clipped and scaled."""
    pi = F.col(pi) if isinstance(pi, str) else pi
    matrix = F.col(matrix) if isinstance(matrix, str) else matrix
    rows = F.zip_with(normalised(pi), matrix, lambda p, row: F.transform(row, lambda a: a * p))
    zero = F.transform(F.get(matrix, F.lit(0)), lambda v: F.lit(0.0))
    return normalised(F.aggregate(rows, zero, lambda acc, row: F.zip_with(acc, row, lambda x, y: x + y)))


def scenario_probabilities(train: str, state: str, weights: str, missing: str = "spread") -> Column:
    """Probability of each train row: its state's weight shared among the state's rows.

    The weight of states absent from the window is spread over all rows (``"spread"``) or
    divided over the present states in proportion (``"renormalise"``).
    """

    def probabilities(states: Column) -> Column:
        def from_counts(counts: Column) -> Column:
            share = F.zip_with(weights, counts, lambda w, c: F.when(c > 0, w / c).otherwise(0.0))
            base = let(share, lambda p: F.transform(states, lambda s: F.coalesce(F.get(p, s), F.lit(0.0))))
            if missing != "spread":
                return normalised(base)
            absent = array_sum(F.zip_with(weights, counts, lambda w, c: F.when(c > 0, 0.0).otherwise(w))) / F.size(states)
            present = let(base, lambda b: F.when(array_sum(b) > 0, let(absent, lambda e: F.transform(b, lambda p: p + e))).otherwise(b))
            return normalised(present)

        return let(_state_counts(states, F.size(weights)), from_counts)

    return let(_train_states(train, state), probabilities)


def radius(gamma: Column | float, n_obs: Column | int, n_assets: Column | int) -> Column:
    """``gamma * n ** (-1 / assets)``."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    n = F.greatest(as_col(n_obs), F.lit(1)).cast("double")
    return as_col(gamma) * F.pow(n, F.lit(-1.0) / F.greatest(as_col(n_assets), F.lit(1)))


def weighted_radius(train: str, state: str, weights: str, gamma: Column, n_assets: Column, missing: str = "spread") -> Column:
    """Regime-weighted radius over the states present in the window; ``"renormalise"`` divides by their weight."""
    states = _train_states(train, state)

    def from_counts(counts: Column) -> Column:
        used = F.zip_with(weights, counts, lambda w, c: F.when((c > 0) & (w > 0), w).otherwise(0.0))
        total = array_sum(F.zip_with(used, counts, lambda w, c: w * radius(gamma, c, n_assets)))
        if missing == "spread":
            return total
        return F.when(array_sum(used) > 0, total / array_sum(used)).otherwise(radius(gamma, F.size(train), n_assets))

    return let(let(states, lambda s: _state_counts(s, F.size(weights))), from_counts)


def weighted_cvar(losses: Column | str, probs: Column | str, eta: float) -> Column:
    """Struct ``(var, cvar)`` of a discrete loss distribution: the first loss whose cumulative
    probability reaches ``eta``, and that loss plus the weighted excess over ``1 - eta``."""
    losses = F.col(losses) if isinstance(losses, str) else losses
    probs = F.col(probs) if isinstance(probs, str) else probs
    ordered = F.array_sort(F.zip_with(losses, probs, lambda loss, p: F.struct(loss.alias("l"), p.alias("p"))))
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("var"))

    def step(acc: Column, cell: Column) -> Column:
        cum = acc["cum"] + cell["p"]
        hit = acc["var"].isNull() & (cum >= eta - 1e-12)
        return F.struct(cum.alias("cum"), F.when(hit, cell["l"]).otherwise(acc["var"]).alias("var"))

    def tail(cells: Column) -> Column:
        var = F.coalesce(F.aggregate(cells, start, step)["var"], F.array_max(F.transform(cells, lambda c: c["l"])))

        def excess(v: Column) -> Column:
            over = F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.greatest(c["l"] - v, F.lit(0.0)) * c["p"])
            return F.struct(v.alias("var"), (v + over / (1 - eta)).alias("cvar"))

        return let(var, excess)

    return let(ordered, tail)
