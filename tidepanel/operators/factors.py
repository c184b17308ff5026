"""Factor returns: exponentially weighted residuals, inverse-volatility mixes, baskets and momentum.

Every operator takes a long panel and builds all its series in one plan. Series are
bounded by their calendar (one row per day); where a computation would still chain over a
whole series with growing numbers, it is cut into blocks that overlap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions import ordered as O
from tidepanel.functions.expr import ratio
from tidepanel.operators import panel as P


def ew_residual(
    df: DataFrame,
    keys: Sequence[str],
    k: int,
    y: str = "y",
    x: str = "x",
    date: str = "date",
    halflife: int = 60,
    min_periods: int = 126,
    ridge: float = 1e-8,
    out: str = "resid",
) -> DataFrame:
    """One-step-ahead residual of an exponentially weighted regression of ``y`` on ``[1, x]``.

    The coefficients of row ``t`` use only rows before it, with weights that halve every
    ``halflife`` rows; the first ``min_periods`` rows have no residual. Rows with a missing
    ``y`` or regressor are left out.

    The weighted moments are window sums. They are taken in blocks of 64 half-lives, each
    preceded by the block before it: anything older weighs less than 2**-64, below the
    resolution of a double, so the blocks give the full sums without overflow and a task
    never orders more than two blocks. Only the small linear systems are solved in numpy.
    """
    block = 64 * halflife
    rows = df.where(F.col(y).isNotNull() & (F.size(x) == k) & F.forall(x, lambda v: v.isNotNull()))
    rows = rows.select(*keys, date, F.col(y).alias("_y"), F.col(x).alias("_x"))
    rows = O.with_position(rows, keys, date, "_t").withColumn("_t", (F.col("_t") - 1).cast("long"))
    own = F.floor(F.col("_t") / block)
    spread = rows.withColumn("_own", own).withColumn("_blk", F.explode(F.array(own, own + 1)))

    step = F.col("_t") - F.col("_blk") * block
    weight = F.pow(F.lit(2.0), step / F.lit(float(halflife)))
    terms = [F.lit(1.0), *[F.get(F.col("_x"), F.lit(i)) for i in range(k)]]
    before = Window.partitionBy(*keys, "_blk").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    scale = F.pow(F.lit(2.0), -(step - 1) / F.lit(float(halflife)))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    spread = spread.withColumn("_g", weight)
    sums = [F.sum(terms[i] * terms[j] * F.col("_g")).over(before).alias(f"_a{i}_{j}") for i, j in pairs]
    sums += [F.sum(terms[i] * F.col("_y") * F.col("_g")).over(before).alias(f"_b{i}") for i in range(k + 1)]
    summed = spread.select(*keys, date, "_t", "_own", "_blk", "_y", "_x", scale.alias("_s"), *sums)
    summed = summed.where(F.col("_own") == F.col("_blk"))
    moments = F.array(*[F.coalesce(F.col(f"_a{i}_{j}") * F.col("_s"), F.lit(0.0)) for i, j in pairs],
                      *[F.coalesce(F.col(f"_b{i}") * F.col("_s"), F.lit(0.0)) for i in range(k + 1)])
    packed = summed.select(*keys, date, "_t", "_y", "_x", moments.alias("_m"))
    upper = np.array([p for p in pairs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            result = np.full(len(batch), np.nan)
            t = batch["_t"].to_numpy()
            ready = np.flatnonzero(t >= min_periods)
            if len(ready):
                m = np.stack(batch["_m"].to_numpy()[ready])
                a = np.zeros((len(ready), k + 1, k + 1))
                a[:, upper[:, 0], upper[:, 1]] = m[:, : len(upper)]
                a[:, upper[:, 1], upper[:, 0]] = m[:, : len(upper)]
                diagonal = np.arange(k + 1)
                a[:, diagonal, diagonal] += (ridge * 0.5 ** (t[ready] / halflife))[:, None]
                b = m[:, len(upper):, None]
                try:
                    beta = np.linalg.solve(a, b)[:, :, 0]
                except np.linalg.LinAlgError:
                    beta = np.full((len(ready), k + 1), np.nan)
                    for n in range(len(ready)):
                        try:
                            beta[n] = np.linalg.solve(a[n], b[n])[:, 0]
                        except np.linalg.LinAlgError:
                            pass
                xs = np.stack(batch["_x"].to_numpy()[ready])
                result[ready] = batch["_y"].to_numpy()[ready] - beta[:, 0] - (xs * beta[:, 1:]).sum(axis=1)
            yield batch[[*keys, date]].assign(**{out: result})

    schema = T.StructType([*[packed.schema[c] for c in (*keys, date)], T.StructField(out, T.DoubleType())])
    solved = packed.mapInPandas(solve, schema)
    return solved.withColumn(out, F.when(~F.isnan(out), F.col(out)))


def inverse_vol_mix(df: DataFrame, group: Sequence[str], leg: str, value: str = "ret", window: int = 252, date: str = "date",
                    name: str = "value") -> DataFrame:
    """Legs weighted by the inverse of their rolling volatility, per group and date.

    Weights use the same day's volatility; a leg that has a volatility but no return on a
    day keeps its share of the weights.
    """
    live = df.where(F.col(value).isNotNull()).select(*group, date).distinct()
    panel = df.join(live, [*group, date], "left_semi")
    panel = O.with_long_rolling(panel, [*group, leg], value, window, window // 2, std="_vol", order=date)
    inverse = ratio(F.lit(1.0), "_vol")
    return panel.groupBy(*group, date).agg((F.sum(F.col(value) * inverse) / F.sum(inverse)).alias(name))


def momentum(df: DataFrame, group: Sequence[str], asset: str, value: str = "ret", lookback: int = 252, date: str = "date",
             name: str = "value") -> DataFrame:
    """Sign of each asset's past return, fixed at month ends, equally weighted over non-zero signs."""
    keys = [*group, asset]
    panel = O.with_long_rolling(df, keys, value, lookback, lookback // 2, total="_total", order=date)
    panel = P.month_end_hold(panel.withColumn("_sign", F.signum("_total")), keys, "_sign")
    sign = F.coalesce("_sign", F.lit(0.0))
    used = F.sum(F.when(sign != 0, 1.0).otherwise(0.0))
    return panel.groupBy(*group, date).agg((F.sum(sign * F.col(value)) / F.nullif(used, F.lit(0.0))).alias(name))


def output_weights(annual: DataFrame, member: str, amount: str, year: str = "year") -> DataFrame:
    """Each member's share of the year's total, valid from the first day of the following year."""
    sums = annual.groupBy(year, member).agg(F.sum(amount).alias("_v"))
    share = F.col("_v") / F.sum("_v").over(Window.partitionBy(year))
    start = F.make_date((F.col(year) + 1).cast("int"), F.lit(1), F.lit(1))
    return sums.select(member, start.alias("date"), share.alias("weight"))


def daily_weights(weights: DataFrame, member: str, start: str, end: str) -> DataFrame:
    """Weights on a business-day calendar: latest known, the first one also before its start."""
    days = P.business_calendar(weights, [member], start, end)
    known = P.as_of(days, weights, [member], ["weight"])
    return known.withColumn("weight", O.backward_fill("weight", [member]))


def currency_basket(prices: DataFrame, weights: DataFrame, member: str, inverted: Sequence[str], start: str, end: str,
                    price: str = "price", renormalise: bool = False, name: str = "value") -> DataFrame:
    """Weighted log return of a basket of quotes, those in ``inverted`` with flipped sign.

    Weights add up to one over the members that have weights, so a missing return lowers
    the exposure; ``renormalise`` spreads it over the members present instead.
    """
    dense = P.align_to_calendar(prices, [member], price, start, end).where(F.col(price).isNotNull())
    moves = P.log_returns(dense, [member], price, "_r")
    moves = moves.withColumn("_r", F.when(F.col(member).isin(*inverted), -F.col("_r")).otherwise(F.col("_r")))
    live = moves.select("date").distinct()
    rows = weights.join(live, "date", "left_semi").join(moves.select(member, "date", "_r"), [member, "date"], "left")
    base = F.sum(F.when(F.col("_r").isNotNull(), F.col("weight"))) if renormalise else F.sum("weight")
    return rows.groupBy("date").agg((F.sum(F.col("_r") * F.col("weight")) / F.nullif(base, F.lit(0.0))).alias(name))


def risk_free(daily: DataFrame, quarterly: DataFrame, priority: Sequence[str], start: str, end: str, limit: int = 10) -> DataFrame:
    """Daily decimal rate from annual percent sources in order of priority, the quarterly bill return behind them.

    ``daily(source, date, rate)`` holds annual percentages, ``quarterly(date, rate)``
    quarter returns as decimals.
    """
    first = P.coalesce_sources(daily, ["date"], "source", "rate", priority).select("date", "rate")
    bill = quarterly.select(F.lit("bill").alias("source"), "date", ((F.pow(1 + F.col("rate"), F.lit(4.0)) - 1) * 100.0).alias("bill"))
    days = P.business_calendar(bill, ["source"], start, end)
    carried = P.as_of(days, bill, ["source"], ["bill"]).select("date", "bill")
    stitched = carried.join(first, "date", "left").select(F.lit("RF").alias("series_id"), "date", F.coalesce("rate", "bill").alias("rate"))
    filled = O.with_position(stitched, ["series_id"])
    filled = filled.withColumn("rate", O.forward_fill("rate", O.by(["series_id"]), limit, "position"))
    return filled.select("date", (F.pow(1 + F.col("rate") / 100.0, F.lit(1.0 / 252)) - 1).alias("rf"))
