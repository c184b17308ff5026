"""Portfolio and tail-risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import ordered as O
from tidepanel.functions.expr import argmax, dot, rounded
from tidepanel.operators import panel as P
from tidepanel.operators import risk as R
from tidepanel.operators import stats as S
from tidepanel.plans import views as V
from tidepanel.plans.oracle_views import r, sql
from tidepanel.plans.registry import query


def _round(df, *keep, digits=6):
    return df.select(*[c if c in keep or t not in ("double",) else rounded(c, digits).alias(c) for c, t in df.dtypes])


PERF = ["n_months", "ann_return", "ann_vol", "sharpe", "var_loss", "cvar_loss", "max_drawdown", "final_wealth"]


def perf_sql(source: str, keys: str, sharpe: str = "mean") -> str:
    """Select list over ``source(keys, month, ret)`` mirroring ``risk.performance``."""
    ratio = "avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)" if sharpe == "mean" else (
        "(CASE WHEN max_by(wealth, month) >= 0 THEN pow(max_by(wealth, month), 12.0 / count(*)) - 1 END) / nullif(stddev_samp(ret) * sqrt(12), 0)")
    return f"""SELECT {keys}, count(*) AS n_months,
        {r("CASE WHEN max_by(wealth, month) >= 0 THEN pow(max_by(wealth, month), 12.0 / count(*)) - 1 END")} AS ann_return,
        {r("stddev_samp(ret) * sqrt(12)")} AS ann_vol, {r(ratio)} AS sharpe, {r("first(var)")} AS var_loss,
        {r("avg(-ret) FILTER (-ret >= var)")} AS cvar_loss, {r("min(wealth / peak - 1)")} AS max_drawdown,
        {r("max_by(wealth, month)")} AS final_wealth
        FROM (SELECT *, max(wealth) OVER (PARTITION BY {keys} ORDER BY month) AS peak,
              quantile_cont(-ret, 0.95) OVER (PARTITION BY {keys}) AS var
              FROM (SELECT *, product(1 + ret) OVER (PARTITION BY {keys} ORDER BY month) AS wealth FROM {source}))
        GROUP BY {keys}"""


@query("perf_metrics", sql(perf_sql("asset_returns", "universe, asset"), "asset_returns"))
def perf_metrics(spark, sf):
    return _round(R.performance(V.asset_returns(spark, sf), ["universe", "asset"]))


_BENCH = """SELECT universe, gamma, strategy, month, ret FROM backtest_small
    UNION ALL SELECT universe, gamma, 'EQUAL_WEIGHT', month, avg(ret) FROM full_returns, (SELECT DISTINCT gamma FROM books) GROUP BY ALL
    UNION ALL SELECT universe, gamma, 'SINGLE_ASSET', month, ret FROM full_returns, (SELECT DISTINCT gamma FROM books) WHERE asset = '1-URGENT'"""


@query("benchmarks", sql(perf_sql("bench", "universe, gamma, strategy", "compound"), "backtest_small", bench=_BENCH))
def benchmarks(spark, sf):
    """Every penalty level beside the benchmarks, which do not depend on it."""
    assets = V.asset_returns(spark, sf).withColumn("gamma", F.explode(F.array(*[F.lit(g) for g in V.GAMMAS])))
    full = R.with_benchmarks(V.backtest_small(spark, sf), assets, ["universe", "gamma"], "1-URGENT")
    return _round(R.performance(full, ["universe", "gamma", "strategy"], sharpe="compound"))


@query("wealth_curve", sql(f"""SELECT universe, asset, month, {r('wealth')} AS wealth, {r('max(wealth) OVER w')} AS peak,
    {r('wealth / max(wealth) OVER w - 1')} AS drawdown FROM (SELECT *, product(1 + ret) OVER (PARTITION BY universe, asset ORDER BY month)
    AS wealth FROM asset_returns) WINDOW w AS (PARTITION BY universe, asset ORDER BY month)""", "asset_returns"))
def wealth_curve(spark, sf):
    return _round(R.wealth_curve(V.asset_returns(spark, sf), ["universe", "asset"]).select("universe", "asset", "month", "wealth", "peak", "drawdown"))


@query("var_cvar", sql(f"""SELECT universe, asset, {r('first(var)')} AS var, {r('avg(-ret) FILTER (-ret >= var)')} AS cvar
    FROM (SELECT *, quantile_cont(-ret, 0.95) OVER (PARTITION BY universe, asset) AS var FROM asset_returns) GROUP BY ALL""", "asset_returns"))
def var_cvar(spark, sf):
    return _round(S.tail_risk(V.asset_returns(spark, sf), ["universe", "asset"], "ret"))


@query("compound_product", sql(f"SELECT universe, asset, {r('product(1 + ret)')} AS growth FROM asset_returns GROUP BY ALL", "asset_returns"))
def compound_product(spark, sf):
    return V.asset_returns(spark, sf).groupBy("universe", "asset").agg(rounded(F.product(1 + F.col("ret"))).alias("growth"))


@query("any_null_month_drop", sql(f"SELECT universe, month, list_transform(r, lambda z: {r('z')}) AS r FROM return_matrix", "return_matrix"))
def any_null_month_drop(spark, sf):
    m = R.return_matrix(V.asset_returns(spark, sf), ["universe"])
    return m.withColumn("r", F.transform("r", lambda v: rounded(v)))


@query("pivot_returns", sql(f"""SELECT universe, month, {', '.join(f"{r(f'max(ret) FILTER (asset[1] = {chr(39)}{i}{chr(39)})')} AS a{i}" for i in range(1, 6))}
    FROM asset_returns GROUP BY ALL""", "asset_returns"))
def pivot_returns(spark, sf):
    short = V.asset_returns(spark, sf).withColumn("asset", F.concat(F.lit("a"), F.substring("asset", 1, 1)))
    return _round(short.groupBy("universe", "month").pivot("asset", [f"a{i}" for i in range(1, 6)]).agg(F.max("ret")))


@query("unpivot_returns", sql(f"""SELECT universe, month, asset, {r('ret')} AS ret FROM (UNPIVOT (
    SELECT universe, month, max(r[1]) AS a1, max(r[2]) AS a2, max(r[3]) AS a3, max(r[4]) AS a4, max(r[5]) AS a5 FROM return_matrix GROUP BY ALL)
    ON a1, a2, a3, a4, a5 INTO NAME asset VALUE ret)""", "return_matrix"))
def unpivot_returns(spark, sf):
    wide = R.return_matrix(V.asset_returns(spark, sf), ["universe"]).select(
        "universe", "month", *[F.get("r", F.lit(i)).alias(f"a{i + 1}") for i in range(5)])
    return _round(wide.unpivot(["universe", "month"], [f"a{i}" for i in range(1, 6)], "asset", "ret"))


@query("turnover", sql(f"""SELECT universe, {r('avg(move)')} AS avg_turnover, {r('max(move)')} AS max_turnover FROM (
    SELECT universe, coalesce(list_sum(list_transform(list_zip(w, lag(w) OVER (PARTITION BY universe ORDER BY month)), lambda z: abs(z[1] - z[2]))), 0) AS move
    FROM (SELECT universe, month, list_transform(r, lambda z: (1 + z) / list_sum(list_transform(r, lambda y: 1 + y))) AS w FROM return_matrix)) GROUP BY ALL""", "return_matrix"))
def turnover(spark, sf):
    return _round(R.turnover(_drift_weights(spark, sf), ["universe"]))


def _drift_weights(spark, sf):
    """Weights proportional to one-month growth: a weight table that moves every month."""
    m = R.return_matrix(V.asset_returns(spark, sf), ["universe"])
    grown = F.transform("r", lambda v: 1 + v)
    total = F.aggregate(grown, F.lit(0.0), lambda s, v: s + v)
    return m.select("universe", "month", F.transform(grown, lambda v: v / total).alias("w"))


@query("concentration", sql(f"""SELECT universe, month, {r('list_max(w)')} AS max_weight, {r('list_dot_product(w, w)')} AS herfindahl,
    {r('1 / list_dot_product(w, w)')} AS effective_n FROM (SELECT universe, month,
    list_transform(r, lambda z: (1 + z) / list_sum(list_transform(r, lambda y: 1 + y))) AS w FROM return_matrix)""", "return_matrix"))
def concentration(spark, sf):
    return _round(R.concentration(_drift_weights(spark, sf)).drop("w"))


@query("out_of_sample_returns", sql(f"""SELECT m.universe, m.month, {r('list_dot_product(m.r, p.w)')} AS ret, {r('-list_dot_product(m.r, p.w)')} AS loss
    FROM return_matrix m JOIN (SELECT universe, lead(month) OVER (PARTITION BY universe ORDER BY month) AS month,
    list_transform(r, lambda z: (1 + z) / list_sum(list_transform(r, lambda y: 1 + y))) AS w FROM return_matrix) p
    ON p.universe = m.universe AND p.month = m.month""", "return_matrix"))
def out_of_sample_returns(spark, sf):
    weights = _drift_weights(spark, sf).withColumn("month", F.lead("month").over(O.by(["universe"], "month"))).where("month IS NOT NULL")
    m = R.return_matrix(V.asset_returns(spark, sf), ["universe"]).join(weights, ["universe", "month"])
    return _round(m.select("universe", "month", dot("r", "w").alias("ret"), (-dot("r", "w")).alias("loss")))


@query("regime_conditional", sql(f"""SELECT universe, gamma, strategy, prev_state, count(*) AS n_months,
    {r('CASE WHEN product(1 + ret) >= 0 THEN pow(product(1 + ret), 12.0 / count(*)) - 1 END')} AS ann_return, {r('stddev_samp(ret) * sqrt(12)')} AS ann_vol,
    {r('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(12)')} AS sharpe, {r('avg(-ret) FILTER (-ret >= var)')} AS tail_loss,
    {r('min(ret)')} AS worst_month, {r('max(ret)')} AS best_month
    FROM (SELECT *, quantile_cont(-ret, 0.95) OVER (PARTITION BY universe, gamma, strategy, prev_state) AS var FROM backtest_small
    WHERE prev_state IS NOT NULL) GROUP BY ALL""", "backtest_small"))
def regime_conditional(spark, sf):
    return _round(R.regime_conditional(V.backtest_small(spark, sf), ["universe", "gamma", "strategy"], "prev_state"), "gamma")


@query("best_gamma", sql(f"SELECT * FROM (SELECT universe, gamma, strategy, sharpe, cvar_loss FROM ({perf_sql('backtest_small', 'universe, gamma, strategy')}) ORDER BY sharpe DESC, gamma, strategy, universe LIMIT 5)", "backtest_small"))
def best_gamma(spark, sf):
    perf = _round(R.performance(V.backtest_small(spark, sf), ["universe", "gamma", "strategy"]), "gamma")
    ranked = perf.orderBy(F.col("sharpe").desc_nulls_last(), "gamma", "strategy", "universe").limit(5)
    return ranked.select("universe", "gamma", "strategy", "sharpe", "cvar_loss")


@query("last_per_group", sql(f"SELECT universe, asset, max(month) AS month, {r('max_by(ret, month)')} AS ret FROM asset_returns GROUP BY ALL", "asset_returns"))
def last_per_group(spark, sf):
    return _round(P.keep_last(V.asset_returns(spark, sf), ["universe", "asset"], ["month"], ["month", "ret"]))


# ---- train windows and scenario weights (24 months stand in for 120) ---------------------------

TRAIN, K = 24, 5

_WINDOWS = f"""SELECT a.universe, a.month, b.month AS train_month, b.r, b.state, b.pos - a.pos + {TRAIN} AS i FROM feed a JOIN feed b
    ON a.universe = b.universe AND b.pos BETWEEN a.pos - {TRAIN} AND a.pos - 1 WHERE a.pos > {TRAIN}"""
_FEED = """SELECT universe, month, r, s.state, row_number() OVER (PARTITION BY universe ORDER BY month) AS pos
    FROM return_matrix JOIN states_monthly s USING (universe, month)"""


def window_feed(spark, sf, n=TRAIN):
    matrix = R.return_matrix(V.asset_returns(spark, sf), ["universe"])
    feed = matrix.join(V.states_monthly(spark, sf), ["universe", "month"])
    return R.train_windows(feed, ["universe"], n, ["r", "state"])


@query("train_windows", sql(f"""SELECT universe, month, min(train_month) AS first_month, max(train_month) AS last_month, count(*) AS n_rows,
    {r('sum(r[1])')} AS total_first FROM windows GROUP BY ALL""", "return_matrix", "states_monthly", feed=_FEED, windows=_WINDOWS))
def train_windows(spark, sf):
    w = window_feed(spark, sf)
    total = F.aggregate("train", F.lit(0.0), lambda s, t: s + t["r"][0])
    return w.select("universe", "month", F.col("train")[0]["month"].alias("first_month"), F.try_element_at("train", F.lit(-1))["month"].alias("last_month"),
                    F.size("train").cast("long").alias("n_rows"), rounded(total).alias("total_first"))


_TRANS = f"""SELECT g.universe, g.month, g.f AS from_state, g.t AS to_state,
    (coalesce(n, 0) + 0.001::DOUBLE) / (sum(coalesce(n, 0)) OVER (PARTITION BY g.universe, g.month, g.f) + {K} * 0.001::DOUBLE) AS p
    FROM (SELECT * FROM (SELECT DISTINCT universe, month FROM windows) CROSS JOIN range({K}) x(f) CROSS JOIN range({K}) y(t)) g
    LEFT JOIN (SELECT universe, month, a, b, count(*) AS n FROM (SELECT universe, month, state AS a,
      lead(state) OVER (PARTITION BY universe, month ORDER BY i) AS b FROM windows) WHERE b IS NOT NULL GROUP BY ALL) c
    ON c.universe = g.universe AND c.month = g.month AND c.a = g.f AND c.b = g.t"""
# the previous month's regime probabilities: 0.8 on its state, 0.05 on the others
_NEXT = f"""SELECT t.universe, t.month, t.to_state AS state, sum(CASE WHEN w.state = t.from_state THEN 0.8::DOUBLE ELSE 0.05::DOUBLE END * t.p) AS w
    FROM trans t JOIN windows w ON w.universe = t.universe AND w.month = t.month AND w.i = {TRAIN - 1} GROUP BY ALL"""
_SCEN = f"""SELECT universe, month, i, train_month, r, state, q / sum(q) OVER (PARTITION BY universe, month) AS p FROM (
    SELECT w.universe, w.month, w.i, w.train_month, w.r, w.state, n.w / count(*) OVER (PARTITION BY w.universe, w.month, w.state)
      + (SELECT coalesce(sum(m.w), 0) FROM nextw m WHERE m.universe = w.universe AND m.month = w.month AND m.state NOT IN
         (SELECT x.state FROM windows x WHERE x.universe = w.universe AND x.month = w.month)) / {TRAIN} AS q
    FROM windows w JOIN nextw n ON n.universe = w.universe AND n.month = w.month AND n.state = w.state)"""
CHAIN = dict(feed=_FEED, windows=_WINDOWS, trans=_TRANS, nextw=_NEXT, scen=_SCEN)


def scenarios(spark, sf, n=TRAIN):
    """Windows with their smoothed transition matrix, next-regime weights and scenario probabilities."""
    w = window_feed(spark, sf, n).withColumn("matrix", R.smoothed_transitions("train", "state", K))
    last = F.try_element_at("train", F.lit(-1))["state"]
    pi = F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: F.when(k == last, 0.8).otherwise(0.05))
    w = w.withColumn("weights", R.next_regime_weights(pi, "matrix"))
    return w.withColumn("probs", R.scenario_probabilities("train", "state", "weights"))


@query("smoothed_transition", sql(f"SELECT universe, month, from_state, to_state, {r('p')} AS p FROM trans", "return_matrix", "states_monthly", **CHAIN))
def smoothed_transition(spark, sf):
    w = window_feed(spark, sf).select("universe", "month", F.posexplode(R.smoothed_transitions("train", "state", K)).alias("from_state", "row"))
    w = w.select("universe", "month", F.col("from_state").cast("long").alias("from_state"), F.posexplode("row").alias("to_state", "p"))
    return w.select("universe", "month", "from_state", F.col("to_state").cast("long").alias("to_state"), rounded("p").alias("p"))


@query("next_regime_weights", sql(f"""SELECT universe, month, state, {r('w / sum(w) OVER (PARTITION BY universe, month)')} AS w,
    arg_max(state, ({r('w', 9)}, -state)) OVER (PARTITION BY universe, month) AS predicted FROM nextw""", "return_matrix", "states_monthly", **CHAIN))
def next_weights(spark, sf):
    w = scenarios(spark, sf).select("universe", "month", argmax(F.transform("weights", lambda v: rounded(v, 9))).alias("predicted"), F.posexplode("weights").alias("state", "w"))
    return w.select("universe", "month", F.col("state").cast("long").alias("state"), rounded("w").alias("w"), "predicted")


@query("scenario_probs", sql(f"SELECT universe, month, train_month, {r('p')} AS p FROM scen", "return_matrix", "states_monthly", **CHAIN))
def scenario_probs(spark, sf):
    cells = F.explode(F.arrays_zip("train", "probs")).alias("c")
    return scenarios(spark, sf).select("universe", "month", cells).select("universe", "month", "c.train.month", "c.probs").toDF(
        "universe", "month", "train_month", "p").withColumn("p", rounded("p"))


@query("robust_radius", sql(f"""SELECT universe, month, gamma, {r('gamma * pow(24.0::DOUBLE, -1.0 / 5)')} AS theta_dr, {r('sum(w * gamma * pow(n, -1.0 / 5))')} AS theta_rsdr
    FROM (SELECT n.universe, n.month, n.w / sum(n.w) OVER (PARTITION BY n.universe, n.month) AS w, (SELECT count(*) FROM windows x WHERE x.universe = n.universe
    AND x.month = n.month AND x.state = n.state)::DOUBLE AS n FROM nextw n) CROSS JOIN (VALUES (0.02::DOUBLE), (0.10::DOUBLE)) g(gamma) WHERE n > 0 GROUP BY ALL""",
    "return_matrix", "states_monthly", **CHAIN))
def robust_radius(spark, sf):
    w = scenarios(spark, sf).select("universe", "month", "train", "weights", F.explode(F.array(*[F.lit(g) for g in V.GAMMAS])).alias("gamma"))
    return w.select("universe", "month", "gamma", rounded(R.radius(F.col("gamma"), TRAIN, 5)).alias("theta_dr"),
                    rounded(R.weighted_radius("train", "state", "weights", F.col("gamma"), F.lit(5))).alias("theta_rsdr"))


_LOSS = "SELECT universe, month, -(0.2::DOUBLE * list_sum(r)) AS l, p FROM scen"
_CUM = "SELECT *, sum(p) OVER (PARTITION BY universe, month ORDER BY l, p ROWS UNBOUNDED PRECEDING) AS cum FROM losses"


@query("weighted_cvar", sql(f"""SELECT universe, month, {r('first(var)')} AS var, {r('first(var) + sum(greatest(l - var, 0) * p) / 0.05')} AS cvar FROM (
    SELECT *, min(l) FILTER (cum >= 0.95 - 1e-12) OVER (PARTITION BY universe, month) AS var FROM cum) GROUP BY ALL""",
    "return_matrix", "states_monthly", **CHAIN, losses=_LOSS, cum=_CUM))
def weighted_cvar(spark, sf):
    """Tail loss of the equal-weight portfolio under each window's scenario probabilities."""
    losses = F.transform("train", lambda t: -(F.aggregate(t["r"], F.lit(0.0), lambda s, v: s + v) * 0.2))
    w = scenarios(spark, sf).select("universe", "month", R.weighted_cvar(losses, "probs", 0.95).alias("c"))
    return _round(w.select("universe", "month", "c.var", "c.cvar"))
