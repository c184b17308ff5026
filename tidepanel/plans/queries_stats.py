"""Descriptive statistics, regime tables and detection metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import rounded
from tidepanel.operators import moments as N
from tidepanel.operators import regimes as G
from tidepanel.operators import stats as S
from tidepanel.plans import views as V
from tidepanel.plans.oracle_views import r, sql
from tidepanel.plans.queries_panel import rnd
from tidepanel.plans.registry import query


@query("factor_summary", sql(f"""SELECT series_id, {r('avg(ret) * 25200')} AS ann_mean_pct, {r('stddev_samp(ret) * sqrt(252) * 100')} AS ann_vol_pct,
    {r('avg(ret) * 25200 / (stddev_samp(ret) * sqrt(252) * 100)')} AS ratio FROM returns GROUP BY ALL""", "returns"))
def factor_summary(spark, sf):
    return rnd(S.factor_summary(V.returns(spark, sf), ["series_id"], "ret"), "ann_mean_pct", "ann_vol_pct", "ratio")


def return_vectors(spark, sf):
    """One array of returns per date, a place for every series of the table in name order."""
    returns = V.returns(spark, sf)
    cells = returns.where("ret IS NOT NULL").groupBy("date").agg(F.map_from_entries(F.array_agg(F.struct("series_id", "ret"))).alias("m"))
    names = returns.groupBy().agg(F.sort_array(F.collect_set("series_id")).alias("names"))  # as wide as the result
    return S.joined(cells, names, [], ["names"]).select("date", F.transform("names", lambda n: F.try_element_at("m", n)).alias("x"))


@query("correlation_matrix", sql(f"""SELECT CAST(i.k AS INT) AS i, CAST(j.k AS INT) AS j, count(*) AS n, {r('corr(a.ret, b.ret)')} AS corr, {r('covar_samp(a.ret, b.ret)')} AS cov
    FROM returns a JOIN returns b USING (date) JOIN names i ON i.series_id = a.series_id JOIN names j ON j.series_id = b.series_id
    WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND i.k <= j.k GROUP BY ALL""", "returns",
    names="SELECT series_id, row_number() OVER (ORDER BY series_id) - 1 AS k FROM (SELECT DISTINCT series_id FROM prices)"))
def correlation_matrix(spark, sf):
    return rnd(N.correlation_pairs(return_vectors(spark, sf), "x").drop("run"), "corr", "cov")


@query("shifted_moments", sql(f"""SELECT CAST(a.feature AS INT) AS i, CAST(b.feature AS INT) AS j, count(*) AS n, {r('covar_samp(a.value, b.value)', 3)} AS cov, {r('corr(a.value, b.value)', 3)} AS corr
    FROM s a JOIN s b USING (row_id) WHERE a.feature <= b.feature GROUP BY ALL""", "features_long", s="SELECT row_id, feature, value * 8 + 1e8::DOUBLE AS value FROM features_long"))
def shifted_moments(spark, sf):
    """Covariances of values whose mean is 1e8 times their deviation; three digits, as the values themselves are only exact to 1e-8."""
    far = V.features(spark, sf).select(F.transform("x", lambda v: v * 8 + 1e8).alias("x"))
    return rnd(N.correlation_pairs(far, "x").drop("run"), "cov", "corr", digits=3)


@query("second_moments", sql(f"""SELECT CAST(a.feature AS INT) AS i, CAST(b.feature AS INT) AS j, {r('covar_samp(a.value, b.value)')} AS cov FROM features_long a
    JOIN features_long b USING (row_id) WHERE a.feature <= b.feature GROUP BY ALL""", "features_long"))
def second_moments(spark, sf):
    return rnd(N.correlation_pairs(V.features(spark, sf), "x").select("i", "j", "cov"), "cov")


_DAY_STATES = "SELECT m.universe, r.series_id, r.date, r.ret, m.state FROM returns r JOIN states_monthly m ON m.month = CAST(date_trunc('month', r.date) AS DATE)"


def labelled(spark, sf):
    """Every day's return under the state of its month in each universe."""
    return V.returns(spark, sf).withColumn("month", F.trunc("date", "month")).join(V.states_monthly(spark, sf), "month")


@query("regime_stats", sql(f"""SELECT universe, state, series_id, count(ret) AS n, {r('avg(ret) * 252')} AS ann_mean, {r('stddev_samp(ret) * sqrt(252)')} AS ann_vol FROM lab GROUP BY ALL""",
    "returns", "states_monthly", lab=_DAY_STATES))
def regime_stats(spark, sf):
    return rnd(G.statistics(labelled(spark, sf), "state", ["universe", "series_id"], "ret"), "ann_mean", "ann_vol")


@query("trailing_means", sql(f"""SELECT series_id, {r('avg(ret) * 252')} AS ann_mean FROM (SELECT * FROM returns WHERE ret IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY date DESC) <= 252) GROUP BY ALL""", "returns"))
def trailing_means(spark, sf):
    from tidepanel.operators import panel as P

    recent = P.tail_rows(V.returns(spark, sf).where("ret IS NOT NULL"), ["series_id"], 252)
    return recent.groupBy("series_id").agg(rounded(F.avg("ret") * 252).alias("ann_mean"))


@query("frequency_table", sql("SELECT state, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM states GROUP BY state", "states"))
def frequency_table(spark, sf):
    return S.frequency(V.states(spark, sf), "state")


@query("group_mode", sql("""SELECT seq_id, state, n FROM (SELECT seq_id, state, count(*) AS n FROM states GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY n DESC, state) = 1""", "states"))
def group_mode(spark, sf):
    return S.mode_smallest(V.states(spark, sf), ["seq_id"], "state")


@query("row_sum_min_count", sql(f"SELECT date, {r('sum(ret)')} AS total, {r('avg(ret)')} AS mean, count(ret) AS n FROM returns GROUP BY date", "returns"))
def row_sum_min_count(spark, sf):
    """Cross-series sum and mean; NULL where no series has a value."""
    return V.returns(spark, sf).groupBy("date").agg(rounded(F.sum("ret")).alias("total"), rounded(F.avg("ret")).alias("mean"), F.count("ret").alias("n"))


@query("quartiles", sql(f"""SELECT feature, {r('quantile_cont(value, 0.25)')} AS q25, {r('quantile_cont(value, 0.5)')} AS median, {r('quantile_cont(value, 0.75)')} AS q75 FROM features_long GROUP BY ALL""", "features_long"))
def quartiles(spark, sf):
    return rnd(S.exact_quantiles(V.features_long(spark, sf), ["feature"], "value", [0.25, 0.5, 0.75], ["q25", "median", "q75"]), "q25", "median", "q75")


@query("panel_quartiles", sql(f"""SELECT series_id, {r('quantile_cont(price, 0.25)')} AS q25, {r('quantile_cont(price, 0.5)')} AS median, {r('quantile_cont(price, 0.75)')} AS q75,
    {r('quantile_cont(price, 0.75) - quantile_cont(price, 0.25)')} AS iqr FROM prices GROUP BY ALL""", "prices"))
def panel_quartiles(spark, sf):
    return rnd(S.quantiles(V.prices(spark, sf), ["series_id"], "price"), "q25", "median", "q75", "iqr")


_CELLS = "SELECT label AS a, list_position(x, list_max(x)) AS b, count(*) AS n FROM features GROUP BY ALL"


@query("adjusted_rand", sql(f"""SELECT CAST(n AS BIGINT) AS n, {r('(ab - ea * eb / (n * (n - 1) / 2.0)) / ((ea + eb) / 2.0 - ea * eb / (n * (n - 1) / 2.0))')} AS ari FROM (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0::DOUBLE) AS ab,
    (SELECT sum(s * (s - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS s FROM cells GROUP BY a)) AS ea, (SELECT sum(s * (s - 1) / 2.0::DOUBLE) FROM (SELECT sum(n) AS s FROM cells GROUP BY b)) AS eb FROM cells)""",
    "features", cells=_CELLS))
def adjusted_rand(spark, sf):
    from tidepanel.functions.expr import argmax

    return rnd(S.adjusted_rand(V.features(spark, sf).select("label", argmax("x").alias("top")), "label", "top"), "ari")


_MONTHS = "SELECT m.universe, m.month, m.state, f.flag FROM states_monthly m JOIN flag_monthly f USING (month)"


def flagged_states(spark, sf):
    return V.states_monthly(spark, sf).join(V.flag_monthly(spark, sf), "month")


@query("recession_metrics", sql("""SELECT universe, tp, fp, fn, recall, precision, round(coalesce(2 * recall * precision / nullif(recall + precision, 0), 0), 3) AS f1 FROM (
    SELECT *, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision FROM (
    SELECT universe, count(*) FILTER (state = 0 AND flag = 1) AS tp, count(*) FILTER (state = 0 AND flag = 0) AS fp, count(*) FILTER (state <> 0 AND flag = 1) AS fn FROM months GROUP BY universe))""",
    "states_monthly", "flag_monthly", months=_MONTHS))
def recession_metrics(spark, sf):
    return G.detection(flagged_states(spark, sf), F.col("state") == 0, F.col("flag") == 1, ["universe"])


@query("state_support", sql("""SELECT universe, state, count(*) AS n_months, CAST(state = 2 AS BIGINT) AS is_crisis, round(100.0::DOUBLE * avg(CASE WHEN flag > 0 THEN 1.0::DOUBLE ELSE 0 END), 1) AS overlap_pct,
    round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY universe), 1) AS pct FROM months GROUP BY universe, state""", "states_monthly", "flag_monthly", months=_MONTHS))
def state_support(spark, sf):
    return G.support(flagged_states(spark, sf), "state", F.col("state") == 2, "flag", ["universe"])


_PROFILES = "SELECT m.universe, m.state, x.series_id, x.value, (x.value - avg(x.value) OVER w) / coalesce(nullif(stddev_pop(x.value) OVER w, 0), 1) AS z FROM macro_monthly x JOIN states_monthly m USING (month) WINDOW w AS (PARTITION BY m.universe, x.series_id)"


@query("state_profile", sql(f"SELECT universe, state, series_id, count(*) AS n, {r('avg(value)', 2)} AS mean_value, {r('avg(z)')} AS mean_z FROM prof GROUP BY ALL", "macro_monthly", "states_monthly", prof=_PROFILES))
def state_profile(spark, sf):
    from tidepanel.operators.features import standardise

    z = standardise(V.macro_monthly(spark, sf).join(V.states_monthly(spark, sf), "month"), ["universe", "series_id"], "value", "z")
    out = G.state_profile(z, "state", ["universe", "series_id"], ["value", "z"])
    return out.select("universe", "state", "series_id", "n", rounded("mean_value", 2).alias("mean_value"), rounded("mean_z").alias("mean_z"))


@query("state_feature_matrix", sql(f"""SELECT universe, series_id, {', '.join(f"{r(f'avg(value) FILTER (state = {k})', 2)} AS state{k}" for k in range(5))} FROM prof GROUP BY ALL""", "macro_monthly", "states_monthly", prof=_PROFILES))
def state_feature_matrix(spark, sf):
    states = V.states_monthly(spark, sf).select("universe", "month", F.concat(F.lit("state"), F.col("state").cast("string")).alias("s"))
    wide = V.macro_monthly(spark, sf).join(states, "month").groupBy("universe", "series_id").pivot("s", [f"state{k}" for k in range(5)]).agg(F.avg("value"))
    return rnd(wide, *[f"state{k}" for k in range(5)], digits=2)


_ROLES = {"Equity": "Brand#1", "Credit": "Brand#2", "Short_Volatility": "Brand#3", "Local_Inflation": "Brand#4", "Commodities": "Brand#5"}
_SCORE = """SELECT universe, state, crisis, steady, mixed * (1 - crisis * 0.8) AS woi, inf FROM (SELECT universe, state, inf, (1 - eq) * 0.5 + (1 - cr) * 0.3 + (1 - sv) * 0.2 AS crisis, eq * 0.7 + (1 - eqv) * 0.3 AS steady,
    (1 - eq) * 0.3 + com * 0.35 + inf * 0.35 AS mixed FROM unit)"""
_STATS = "SELECT universe, state, series_id, avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS v FROM lab GROUP BY ALL"
_RAW = "SELECT universe, state, " + ", ".join(f"coalesce(max({c}) FILTER (series_id = '{b}'), 0) AS {n}" for n, c, b in (("eq", "m", "Brand#1"), ("cr", "m", "Brand#2"), ("sv", "m", "Brand#3"), ("inf", "m", "Brand#4"), ("com", "m", "Brand#5"), ("eqv", "v", "Brand#1"))) + " FROM st GROUP BY ALL"
_UNIT = "SELECT universe, state, " + ", ".join(f"({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-12) AS {c}" for c in ("eq", "cr", "sv", "inf", "com", "eqv")) + " FROM raw WINDOW w AS (PARTITION BY universe)"
_TAKE = lambda source, c, used: f"SELECT *, NOT ({used}) AND row_number() OVER (PARTITION BY universe, ({used}) ORDER BY {c} DESC, state) = 1 AS is_{c} FROM {source}"
_TAKEN = {"p1": _TAKE("score", "crisis", "false"), "p2": _TAKE("p1", "steady", "is_crisis"), "p3": _TAKE("p2", "woi", "is_crisis OR is_steady"), "p4": _TAKE("p3", "inf", "is_crisis OR is_steady OR is_woi")}
_NAMED = """SELECT *, CASE WHEN is_crisis THEN 'Crisis' WHEN is_steady THEN 'Steady_State' WHEN is_woi THEN 'WOI' WHEN is_inf THEN 'Inflation' END AS canon,
    CASE greatest(crisis, steady, woi, inf) WHEN crisis THEN 'Crisis' WHEN steady THEN 'Steady_State' WHEN woi THEN 'WOI' ELSE 'Inflation' END AS fav FROM p4"""
_NAMES = {"lab": _DAY_STATES, "st": _STATS, "raw": _RAW, "unit": _UNIT, "score": _SCORE, **_TAKEN, "named": _NAMED}
_NAME = "coalesce(canon, fav || '_' || chr(CAST(64 + row_number() OVER (PARTITION BY universe, canon IS NULL, fav ORDER BY state) AS INT)))"


@query("regime_names", sql(f"SELECT universe, state, {_NAME} AS name FROM named", "returns", "states_monthly", **_NAMES))
def regime_names(spark, sf):
    stats = G.statistics(labelled(spark, sf), "state", ["universe", "series_id"], "ret")
    return G.auto_names(G.score_table(stats, "state", ["universe"], roles=_ROLES), "state", ["universe"])


@query("regime_relabel", sql(f"SELECT universe, state, CASE state WHEN 0 THEN 'Stress' ELSE {_NAME} END AS name FROM named", "returns", "states_monthly", **_NAMES))
def regime_relabel(spark, sf):
    return G.relabel(regime_names(spark, sf), {0: "Stress"}, "state")


@query("state_probs_normalise", sql(f"""SELECT entity, list_transform(list_value(greatest(a, 0), greatest(b, 0), greatest(c, 0)), lambda v: CASE WHEN greatest(a, 0) + greatest(b, 0) + greatest(c, 0) > 0
    THEN {r('v / (greatest(a, 0) + greatest(b, 0) + greatest(c, 0))')} ELSE {r('1.0::DOUBLE / 3')} END) AS p FROM (SELECT user_id AS entity, CAST(count(*) FILTER (event_type = 'click') - 15 AS DOUBLE) AS a, CAST(count(*) FILTER (event_type = 'view') - 15 AS DOUBLE) AS b,
    CAST(count(*) FILTER (event_type = 'error') - 15 AS DOUBLE) AS c FROM events GROUP BY ALL)"""))
def state_probs_normalise(spark, sf):
    """Row-normalised state shares, uniform where all are zero."""
    from tidepanel.functions.expr import normalised

    hits = lambda t: (F.sum(F.when(F.col("event_type") == t, 1).otherwise(0)) - 15).cast("double")
    raw = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(F.array(hits("click"), hits("view"), hits("error")).alias("p"))
    return raw.select("entity", F.transform(normalised("p"), lambda v: rounded(v)).alias("p"))


@query("regime_artifacts", sql(f"""SELECT CAST(date_trunc('month', t.day) AS DATE) AS month, arg_max(n.name, t.day) AS regime FROM (SELECT CAST(ts AS DATE) AS day, arg_max(state, (ts, event_id)) AS state FROM states GROUP BY ALL) t
    JOIN (SELECT state, name FROM (SELECT state, CASE WHEN state < 2 THEN 'low' ELSE 'high' END AS name, count(*) AS n FROM states GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY state ORDER BY n DESC, name) = 1) n USING (state) GROUP BY ALL""", "states"))
def regime_artifacts(spark, sf):
    """Number-to-name map by most frequent pairing, then the month's last daily regime name."""
    from tidepanel.operators import sequences as Q

    states = V.states(spark, sf)
    named = states.withColumn("name", F.when(F.col("state") < 2, "low").otherwise("high"))
    names = S.mode_smallest(named, ["state"], "name").select("state", "name")
    daily = states.groupBy(F.to_date("ts").alias("day")).agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    last = Q.last_per_period(daily, [], F.trunc("day", "month"), ["day"], ["state"])
    return last.join(names, "state").select("month", F.col("name").alias("regime"))


@query("latest_probabilities", sql(f"""SELECT entity, date, 'Regime_' || (i - 1) AS name, {r('p[i] / list_sum(p)')} AS probability FROM (SELECT entity, date, p, unnest(range(1, 6)) AS i FROM (
    SELECT user_id AS entity, max(CAST(ts AS DATE)) AS date, arg_max([a, b, c, d, e], d0) AS p FROM (SELECT user_id, CAST(ts AS DATE) AS d0, max(ts) AS ts, {', '.join(f"CAST(1 + count(*) FILTER (event_type = '{t}') AS DOUBLE) AS {n}" for t, n in zip(V.EVENT_TYPES, 'abcde'))}
    FROM events GROUP BY user_id, d0) GROUP BY user_id)) WHERE i <> 3 UNION ALL SELECT entity, date, 'Calm', {r('p[3] / list_sum(p)')} FROM (
    SELECT user_id AS entity, max(CAST(ts AS DATE)) AS date, arg_max([a, b, c, d, e], d0) AS p FROM (SELECT user_id, CAST(ts AS DATE) AS d0, max(ts) AS ts, {', '.join(f"CAST(1 + count(*) FILTER (event_type = '{t}') AS DOUBLE) AS {n}" for t, n in zip(V.EVENT_TYPES, 'abcde'))}
    FROM events GROUP BY user_id, d0) GROUP BY user_id)"""))
def latest_probabilities(spark, sf):
    """Latest day's state shares per user, with one state named."""
    from tidepanel.functions.expr import normalised

    hits = [F.sum(F.when(F.col("event_type") == t, 1.0).otherwise(0.0)) + 1 for t in V.EVENT_TYPES]
    days = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("entity"), F.to_date("ts").alias("date")).agg(F.array(*hits).alias("p"))
    days = days.withColumn("p", normalised("p"))
    names = days.select("entity").distinct().select("entity", F.lit(2).cast("long").alias("state"), F.lit("Calm").alias("name"))
    return rnd(G.latest_probabilities(days, names, "date", ["entity"]), "probability")
