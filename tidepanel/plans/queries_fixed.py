"""The apply steps of fitted models under stated parameters: what a fit only chooses, SQL can check here."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tidepanel.functions.expr import rounded
from tidepanel.operators import features as J
from tidepanel.operators import hmm as H
from tidepanel.operators import mixture as M
from tidepanel.operators import moments as N
from tidepanel.plans import views as V
from tidepanel.plans.oracle_views import r, sql
from tidepanel.plans.registry import query


def arr(c, digits=6):
    return F.transform(c, lambda v: rounded(v, digits))


# ---- component scores -------------------------------------------------------------------------------

# Three directions over the 64 components.
DIRECTIONS = [[((j * (k + 2)) % 7 - 3) / 16 for j in range(64)] for k in range(3)]
_Z = "SELECT row_id, feature, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM features_long WINDOW w AS (PARTITION BY feature)"
_SCORE = ", ".join(r(f"sum(z * ({d}::DOUBLE[])[feature + 1])", 5) for d in DIRECTIONS)


@query("component_scores", sql(f"SELECT row_id, [{_SCORE}] AS scores FROM z GROUP BY row_id", "features_long", z=_Z))
def component_scores(spark, sf):
    """Scores of the standardised rows along stated loadings."""
    data = V.features(spark, sf)
    mean, cov, n = N.covariance_matrix(data, "x")
    model = J.Components(mean, np.sqrt(np.diag(cov) * (n - 1) / n), np.array(DIRECTIONS), np.zeros(3), n)
    return model.scores(data, "x").select("row_id", arr("scores", 5).alias("scores"))


# ---- mixtures ------------------------------------------------------------------------------------------

# Three components over the first two of the 64 values, with full covariances or their diagonals.
WEIGHTS = [0.5, 0.3, 0.2]
MEANS = [[0.0, 0.5], [1.0, -1.0], [-1.5, 0.25]]
COVS = [[[1.0, 0.3], [0.3, 0.5]], [[2.0, -0.5], [-0.5, 1.0]], [[0.7, 0.0], [0.0, 1.5]]]


def _log_density(k: int, diagonal: bool) -> str:
    (a, b), (_, c) = COVS[k]
    b = 0.0 if diagonal else b
    det = a * c - b * b
    u, v = f"(x[1] - ({MEANS[k][0]}))", f"(x[2] - ({MEANS[k][1]}))"
    return f"{math.log(WEIGHTS[k])!r} - 0.5 * (({c} * {u} * {u} - 2 * ({b}) * {u} * {v} + {a} * {v} * {v}) / {det!r} + {math.log(det)!r} + {2 * math.log(2 * math.pi)!r})"


def _mixture_sql(diagonal: bool) -> str:
    joint = f"SELECT row_id, [{', '.join(_log_density(k, diagonal) for k in range(3))}] AS l FROM (SELECT row_id, x FROM features)"
    norm = "SELECT row_id, l, list_max(l) + ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) AS n FROM joint"
    return sql(f"SELECT row_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS label, list_transform(l, lambda v: {r('exp(v - n)')}) AS p, {r('n')} AS logp FROM norm", "features", joint=joint, norm=norm)


def _mixture(spark, sf, diagonal):
    covs = np.array([np.diag(c) for c in np.array(COVS)]) if diagonal else np.array(COVS)
    model = M.Mixture("stated", np.array(WEIGHTS), np.array(MEANS), covs, np.zeros(2), np.ones(2))
    rows = V.features(spark, sf).select(F.col("row_id").alias("idx"), F.slice("x", 1, 2).alias("x"))
    return M.score(rows, [model]).select(F.col("idx").alias("row_id"), "label", arr("p").alias("p"), rounded("logp").alias("logp"))


@query("mixture_scores_full", _mixture_sql(False))
def mixture_scores_full(spark, sf):
    return _mixture(spark, sf, False)


@query("mixture_scores_diag", _mixture_sql(True))
def mixture_scores_diag(spark, sf):
    return _mixture(spark, sf, True)


_STEP_ROWS = [f"exp({_log_density(k, False)} - n)" for k in range(3)]
_EM = f"""SELECT unnest([0, 1, 2]) AS component, unnest([{', '.join(_STEP_ROWS)}]) AS g, x[1] AS u, x[2] AS v FROM (SELECT x, list_max(l) + ln(list_sum(list_transform(l, lambda q: exp(q - list_max(l))))) AS n FROM
    (SELECT x, [{', '.join(_log_density(k, False) for k in range(3))}] AS l FROM features))"""
_MU = "SELECT component, sum(g) AS s, sum(g * u) / sum(g) AS mu, sum(g * v) / sum(g) AS mv FROM resp GROUP BY component"


@query("mixture_step", sql(f"""SELECT CAST(component AS INT) AS component, {r('max(s) / (SELECT count(*) FROM features)')} AS weight, {r('max(mu)')} AS mean_0, {r('max(mv)')} AS mean_1,
    {r('sum(g * (u - mu) * (u - mu)) / max(s)')} AS cov_00, {r('sum(g * (u - mu) * (v - mv)) / max(s)')} AS cov_01, {r('sum(g * (v - mv) * (v - mv)) / max(s)')} AS cov_11 FROM resp JOIN mu USING (component) GROUP BY component""",
    "features", resp=_EM, mu=_MU))
def mixture_step(spark, sf):
    """One step of expectation maximisation from the stated parameters."""
    model = M.Mixture("stated", np.array(WEIGHTS), np.array(MEANS), np.array(COVS), np.zeros(2), np.ones(2))
    rows = V.features(spark, sf).select(F.col("row_id").alias("idx"), F.slice("x", 1, 2).alias("x"))
    m = M.step(rows, {"stated": model})["stated"]
    table = [(k, float(m.weights[k]), *map(float, m.means[k]), float(m.covs[k, 0, 0]), float(m.covs[k, 0, 1]), float(m.covs[k, 1, 1])) for k in range(3)]
    out = spark.createDataFrame(table, "component int, weight double, mean_0 double, mean_1 double, cov_00 double, cov_01 double, cov_11 double")
    return out.select("component", *[rounded(c).alias(c) for c in out.columns[1:]])


# ---- hidden Markov chains --------------------------------------------------------------------------------

# Three states over the number of an entity's daily events and their mean value.
CHAIN = H.HiddenMarkov(np.array([[-1.0, -0.2], [0.5, 0.1], [1.5, 0.4]]), np.log(np.array([[0.6, 0.3], [0.9, 0.5], [1.6, 0.2]])),
                       np.array([[0.7, 0.2, 0.1], [0.15, 0.75, 0.1], [0.25, 0.25, 0.5]]), np.array([0.5, 0.3, 0.2]))
_STATES = range(3)


def _emission(k: int) -> str:
    parts = " + ".join(f"(x{j} - ({CHAIN.means[k, j]!r})) * (x{j} - ({CHAIN.means[k, j]!r})) * {math.exp(-CHAIN.log_vars[k, j])!r}" for j in range(2))
    return f"-0.5 * ({parts} + {float(CHAIN.log_vars[k].sum() + 2 * math.log(2 * math.pi))!r})"


def _plain(v) -> str:
    return repr(float(v))


_LB = f"""SELECT entity, date, t, [{', '.join(_emission(k).replace('np.float64', '') for k in _STATES)}] AS b FROM (SELECT entity, date, n_events - 2 AS x0, mean_value / 50 - 1 AS x1,
    row_number() OVER (PARTITION BY entity ORDER BY date) AS t FROM event_features)"""
_UNIT = "list_transform({0}, lambda v: v / list_sum({0}))"
_FORWARD = f"""SELECT entity, date, t, {_UNIT.format('q')} AS p FROM (SELECT entity, date, t, [{', '.join(f'{_plain(CHAIN.start[k])} * exp(b[{k + 1}])' for k in _STATES)}] AS q FROM lb WHERE t = 1)
    UNION ALL SELECT entity, date, t, {_UNIT.format('q')} AS p FROM (SELECT lb.entity, lb.date, lb.t, [{', '.join('(' + ' + '.join(f'f.p[{i + 1}] * {_plain(CHAIN.transition[i, k])}' for i in _STATES) + f') * exp(lb.b[{k + 1}])' for k in _STATES)}] AS q
    FROM forward f JOIN lb ON lb.entity = f.entity AND lb.t = f.t + 1)"""


def _best(k: int) -> str:
    return "[" + ", ".join(f"v.d[{i + 1}] + {_plain(math.log(CHAIN.transition[i, k]))}" for i in _STATES) + "]"


_VITERBI = f"""SELECT entity, date, t, [{', '.join(f'{_plain(math.log(CHAIN.start[k]))} + b[{k + 1}]' for k in _STATES)}] AS d, [0, 0, 0] AS bp FROM lb WHERE t = 1
    UNION ALL SELECT lb.entity, lb.date, lb.t, [{', '.join(f'list_max({_best(k)}) + lb.b[{k + 1}]' for k in _STATES)}] AS d, [{', '.join(f'CAST(list_position({_best(k)}, list_max({_best(k)})) - 1 AS INT)' for k in _STATES)}] AS bp
    FROM viterbi v JOIN lb ON lb.entity = v.entity AND lb.t = v.t + 1"""
_BACK = """SELECT entity, t, CAST(list_position(d, list_max(d)) - 1 AS BIGINT) AS state FROM viterbi WHERE (entity, t) IN (SELECT (entity, max(t)) FROM lb GROUP BY entity)
    UNION ALL SELECT v.entity, v.t - 1, CAST(v.bp[b.state + 1] AS BIGINT) FROM back b JOIN viterbi v ON v.entity = b.entity AND v.t = b.t WHERE b.t > 1"""


def _recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def chain_blocks(spark, sf):
    rows = V.event_features(spark, sf).select("entity", "date", F.array(F.col("n_events") - 2, F.col("mean_value") / 50 - 1).alias("x"))
    return H.to_blocks(rows, "entity", "date", "x", 16)


@query("chain_filter", _recursive(sql(f"SELECT entity, date, list_transform(p, lambda v: {r('v')}) AS p FROM forward", "event_features", lb=_LB, forward=_FORWARD)))
def chain_filter(spark, sf):
    """Filtered probabilities of every row under stated parameters."""
    return H.filtered(chain_blocks(spark, sf), CHAIN).select(F.col("seq").alias("entity"), "date", arr("p").alias("p"))


@query("chain_path", _recursive(sql("SELECT lb.entity, lb.date, back.state FROM back JOIN lb ON lb.entity = back.entity AND lb.t = back.t", "event_features", lb=_LB, viterbi=_VITERBI, back=_BACK)))
def chain_path(spark, sf):
    """Most likely paths under stated parameters."""
    return H.decode(chain_blocks(spark, sf), CHAIN).select(F.col("seq").alias("entity"), "date", "state")
