"""Mixture, hidden Markov, cluster and backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import expr as E
from tidepanel.functions.expr import rounded
from tidepanel.operators import clusters as C
from tidepanel.operators import evaluate as Q
from tidepanel.operators import hmm as H
from tidepanel.operators import mixture as M
from tidepanel.operators import optimise as Z
from tidepanel.operators import risk as R
from tidepanel.operators.passes import Span
from tidepanel.operators.passes import numbered as numbered_rows
from tidepanel.plans import views as V
from tidepanel.plans.oracle_views import r, sql
from tidepanel.plans.queries_panel import rnd
from tidepanel.plans.queries_risk import TRAIN, K
from tidepanel.plans.registry import query
from tidepanel.session import kept
from tidepanel.sources import shaping


def arr(c, digits=6):
    return F.transform(c, lambda v: rounded(v, digits))


# ---- daily vectors: mean return of five groups of series -------------------------------------------

def group_vectors(spark, sf):
    """``(idx, date, x)``: days since 1970 and the mean returns of the brands by number modulo five."""
    group = F.substring("series_id", 7, 3).cast("int") % 5
    cells = V.returns(spark, sf).where("ret IS NOT NULL").groupBy("date").agg(*[F.avg(F.when(group == g, F.col("ret"))).alias(f"g{g}") for g in range(5)])
    rows = cells.dropna().select("date", F.array(*[f"g{g}" for g in range(5)]).alias("x"))
    return rows.select(F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("idx"), "date", "x")


@query("gmm_full")
def gmm_full(spark, sf):
    data = group_vectors(spark, sf)
    model = M.fit(data, M.restarts("daily", 4, 20), max_iter=1000)["daily"]
    return M.score(data, [model], keep=["date"]).select("date", "label", arr("p").alias("p"))


@query("gmm_diag")
def gmm_diag(spark, sf):
    data = V.features(spark, sf).select(F.col("row_id").alias("idx"), "x")
    model = M.fit(data, M.restarts("emb", 6, 10), covariance="diag")["emb"]
    return M.score(data, [model]).select("idx", "label", arr("p").alias("p"))


@query("gmm_criteria")
def gmm_criteria(spark, sf):
    """AIC and BIC per number of components, all fits in the same passes."""
    data = group_vectors(spark, sf)
    fits = M.fit(data, [run for k in range(2, 7) for run in M.restarts(str(k), k, 10)], max_iter=500)
    rows = [(int(k), float(m.loglik), float(m.aic()), float(m.bic())) for k, m in fits.items()]
    return rnd(spark.createDataFrame(rows, "k int, loglik double, aic double, bic double"), "loglik", "aic", "bic", digits=4)


def numbered(spark, sf):
    """Standardised vectors numbered 0 … n-1 in date order."""
    rows = group_vectors(spark, sf).select("date", F.posexplode("x").alias("j", "v"))
    from tidepanel.operators.features import standardise

    z = standardise(rows, ["j"], "v", "z").groupBy("date").agg(F.array_sort(F.array_agg(F.struct("j", "z"))).alias("c"))
    return numbered_rows(z.select("date", F.transform("c", lambda c: c["z"]).alias("x")), "date")


@query("gmm_cross_validation")
def gmm_cross_validation(spark, sf):
    data = numbered(spark, sf).persist()
    n = data.count()
    scores = M.cross_validate(data, n, range(2, 7), folds=5, n_init=20)
    data.unpersist()
    return rnd(scores, "score")


_FEATURE_SCORE = "SELECT label AS run, CAST(feature // 8 AS INT) + 2 AS k, max(value) AS score FROM features_long GROUP BY ALL"


@query("choose_components", sql("""SELECT run, coalesce(min(prev) FILTER (total > 0 AND gain / total < 0.2), max(k)) AS k FROM (SELECT *, score - lag(score) OVER w AS gain, lag(k) OVER w AS prev,
    last_value(score) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(score) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total
    FROM sc WINDOW w AS (PARTITION BY run ORDER BY k)) GROUP BY run""", "features_long", sc=_FEATURE_SCORE))
def choose_components(spark, sf):
    """The 20 % rule on one score curve per label."""
    return M.choose_components(_curves(spark, sf), keys=["run"])


def _curves(spark, sf):
    return V.features_long(spark, sf).groupBy(F.col("label").alias("run"), (F.floor(F.col("feature") / 8) + 2).cast("int").alias("k")).agg(F.max("value").alias("score"))


@query("elbow_by_curvature", sql("""SELECT run, k FROM (SELECT run, k, lead(score) OVER w - 2 * score + lag(score) OVER w AS bend FROM sc WINDOW w AS (PARTITION BY run ORDER BY k)) WHERE bend IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY run ORDER BY bend DESC, k) = 1""", "features_long", sc=_FEATURE_SCORE))
def elbow_by_curvature(spark, sf):
    return M.elbow_by_curvature(_curves(spark, sf).withColumnRenamed("score", "inertia"), ["run"])


@query("current_regime")
def current_regime(spark, sf):
    """Probabilities of the last 60 rows under the fitted model."""
    data = group_vectors(spark, sf)
    model = M.fit(data, M.restarts("daily", 4, 20), max_iter=1000)["daily"]
    recent = data.orderBy(F.col("date").desc()).limit(60)
    return M.score(recent, [model], keep=["date"]).select("date", "label", arr("p").alias("p"))


@query("walk_forward_mixture")
def walk_forward_mixture(spark, sf):
    """Refit every three months on five years, probabilities of the following three months."""
    data = group_vectors(spark, sf).persist()
    splits = shaping.walk_forward(data, [], 5, 3)
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    spans = splits.select(F.date_format("refit_date", "yyyy-MM-dd").alias("m"), day("train_from").alias("a"), day("refit_date").alias("b"), day("test_to").alias("c")).collect()
    sizes = {s["m"]: 0 for s in spans}
    marked = data.select("idx", F.explode(F.array(*[F.struct(F.lit(s["m"]).alias("m"), F.lit(s["a"]).alias("a"), F.lit(s["b"]).alias("b")) for s in spans])).alias("s"))
    for row in marked.where("idx >= s.a AND idx < s.b").groupBy("s.m").count().collect():
        sizes[row["m"]] = row["count"]
    usable = [s for s in spans if sizes[s["m"]] >= 100]
    runs = [run for s in usable for run in M.restarts(s["m"], 4, 10, span=Span(s["a"], s["b"]))]
    models = M.fit(data, runs, max_iter=500)
    out = M.score(data, list(models.values()), {s["m"]: Span(s["b"], s["c"]) for s in usable}, keep=["date"])
    return out.select(F.col("model").alias("refit_date"), "date", arr("p").alias("p"))


# ---- hidden Markov -----------------------------------------------------------------------------------

def hmm_inputs(spark, sf, width=366):
    events = V.event_features(spark, sf)
    m = events.agg(F.avg("n_events").alias("a"), F.stddev_pop("n_events").alias("b"), F.avg("mean_value").alias("c"), F.stddev_pop("mean_value").alias("d")).first()
    rows = events.select("entity", "date", F.array((F.col("n_events") - m["a"]) / (m["b"] or 1.0), (F.col("mean_value") - m["c"]) / (m["d"] or 1.0)).alias("x"))
    blocks = H.stored(H.to_blocks(rows, "entity", "date", "x", width))
    return rows, blocks


def fitted_hmm(spark, sf):
    rows, blocks = hmm_inputs(spark, sf)
    return rows, blocks, H.fit(blocks, H.numbered_rows(rows, ["entity", "date"]), H.restarts("chain", 6))["chain"]


@query("hmm_fit")
def hmm_fit(spark, sf):
    """Transition matrix and state means of the fitted model; rows of the matrix add up to one."""
    _, blocks, m = fitted_hmm(spark, sf)
    blocks.unpersist()
    rows = [(i, "to_state", j, float(v)) for i, row in enumerate(m.transition) for j, v in enumerate(row)]
    rows += [(i, "mean", j, float(v)) for i, row in enumerate(m.means) for j, v in enumerate(row)]
    return rnd(spark.createDataFrame(rows, "state int, kind string, j int, value double"), "value")


@query("hmm_viterbi")
def hmm_viterbi(spark, sf):
    _, blocks, m = fitted_hmm(spark, sf)
    return H.decode(blocks, m).select(F.col("seq").alias("entity"), "date", "state")


@query("hmm_filter")
def hmm_filter(spark, sf):
    _, blocks, m = fitted_hmm(spark, sf)
    return H.filtered(blocks, m).select(F.col("seq").alias("entity"), "date", arr("p").alias("p"))


@query("state_export")
def state_export(spark, sf):
    """``(date, state, crisis, p_crisis, p_state…)`` of the fitted model: the table portfolios read."""
    rows, blocks, m = fitted_hmm(spark, sf)
    path = H.decode(blocks, m)
    probs = H.filtered(blocks, m)
    labelled = path.join(rows.select(F.col("entity").alias("seq"), "date", "x"), ["seq", "date"])
    crisis = C.crisis_state(labelled, "x", "state")
    out = path.join(probs, ["seq", "date"])
    return out.select(F.col("seq").alias("entity"), "date", "state", (F.col("state") == crisis).cast("long").alias("crisis"), rounded(F.get("p", F.lit(crisis))).alias("p_crisis"),
                      *[rounded(F.get("p", F.lit(k))).alias(f"p_state{k}") for k in range(m.means.shape[0])])


# Fixed value: selections see months up to here only.
SEEN_UNTIL = "1999-12-31"


def engine_inputs(spark, sf):
    """The prepared bundles, the flag and the features that selecting configurations take."""
    from tidepanel.plans import engines
    from tidepanel.plans.queries_features import prepared_bundles

    long, flag = kept(prepared_bundles(spark, sf)), V.flag_monthly(spark, sf)
    return long, flag, kept(engines.select_features(long, flag, SEEN_UNTIL))


@query("engine_selection")
def engine_selection(spark, sf):
    """Screen size and mean rank of the two bundles that configurations select from, ranked against regimes of a third."""
    return rnd(engine_inputs(spark, sf)[2], "mean_rank")


@query("engine_grid")
def engine_grid(spark, sf):
    """Two engines on five feature configurations: sizes, quality, agreement of ten seeds and detection figures per fit."""
    from tidepanel.plans import engines

    long, flag, chosen = engine_inputs(spark, sf)
    table = engines.diagnostics(engines.fit_chain(long, chosen=chosen), flag)
    return rnd(table, *[c for c, t in table.dtypes if t == "double"], digits=3)


# ---- distances, layers, outliers ------------------------------------------------------------------------

# Three reference directions for the distance checks.
CENTROIDS = [[1.0 if j % 3 == k else -0.5 for j in range(64)] for k in range(3)]
_CENT = ", ".join(str(c) + "::DOUBLE[]" for c in CENTROIDS)
_COS = f"SELECT row_id, x, list_transform([{_CENT}], lambda c: 1 - list_dot_product(x, c) / ((sqrt(list_dot_product(x, x)) + 1e-12) * (sqrt(list_dot_product(c, c)) + 1e-12))) AS d FROM features"


@query("cosine_assign", sql(f"SELECT row_id, list_transform(d, lambda v: {r('v')}) AS d, CAST(list_position(d, list_min(d)) AS BIGINT) AS label FROM cosd", "features", cosd=_COS))
def cosine_assign(spark, sf):
    out = V.features(spark, sf).select("row_id", C.distances("x", CENTROIDS).alias("d"))
    return out.select("row_id", arr("d").alias("d"), (E.argmin("d") + 1).alias("label"))


@query("euclidean_distances", sql(f"SELECT row_id, list_transform([{_CENT}], lambda c: {r('list_distance(x, c)')}) AS d FROM features", "features"))
def euclidean_distances(spark, sf):
    return V.features(spark, sf).select("row_id", arr(C.distances("x", CENTROIDS, "euclidean")).alias("d"))


@query("membership_probs", sql(f"""SELECT row_id, list_transform(d, lambda v: {r('((1 - v / (list_sum(d) + 1e-12)) / (list_sum(list_transform(d, lambda w: 1 - w / (list_sum(d) + 1e-12))) + 1e-12))')}) AS p FROM cosd""", "features", cosd=_COS))
def membership_probs(spark, sf):
    return V.features(spark, sf).select("row_id", arr(E.membership(C.distances("x", CENTROIDS))).alias("p"))


_MOM = "SELECT feature, avg(value) AS m, var_samp(value) + 1e-12 AS v FROM features_long GROUP BY feature"
_MAHA = "SELECT row_id, sqrt(sum((value - m) * (value - m) / v)) AS d FROM features_long JOIN mom USING (feature) GROUP BY row_id"


@query("mahalanobis_outlier", sql(f"""SELECT row_id, {r('d')} AS d, d >= t AS is_outlier, {r('1 / (1 + exp(-(d - t) / (mad + 1e-9)))')} AS p_outlier FROM (SELECT *, median(abs(d - med)) OVER () AS mad FROM (
    SELECT *, quantile_cont(d, 0.85) OVER () AS t, median(d) OVER () AS med FROM maha))""", "features_long", mom=_MOM, maha=_MAHA))
def mahalanobis_outlier(spark, sf):
    long = V.features_long(spark, sf)
    m = long.groupBy("feature").agg(F.avg("value").alias("m"), (F.var_samp("value") + 1e-12).alias("v"))
    part = F.pow(F.col("value") - F.col("m"), F.lit(2.0)) / F.col("v")
    d = long.join(m, "feature").groupBy("row_id").agg(F.sqrt(F.sum(part)).alias("d"))
    out = C.outlier_table(d, [], "d", 0.15)
    return rnd(out.select("row_id", "d", "is_outlier", "p_outlier"), "d", "p_outlier")


@query("soft_label", sql(f"""SELECT row_id, list_transform(f, lambda v: {r('v / (list_sum(f) + 1e-12)')}) AS p FROM (SELECT row_id, list_concat([-list_max(p) * log2(1 - least(0.9, abs(x[1]) / 10))], p) AS f FROM (
    SELECT row_id, x, list_transform(d, lambda v: (1 - v / (list_sum(d) + 1e-12)) / (list_sum(list_transform(d, lambda w: 1 - w / (list_sum(d) + 1e-12))) + 1e-12)) AS p FROM cosd))""", "features", cosd=_COS))
def soft_label(spark, sf):
    """Outlier share raised by ``-max(p) log2(1 - p0)`` in front of the cosine memberships."""
    p = V.features(spark, sf).select("row_id", "x", E.membership(C.distances("x", CENTROIDS)).alias("p"))
    p0 = F.least(F.lit(0.9), F.abs(F.get("x", F.lit(0))) / 10)
    full = F.concat(F.array(-F.array_max("p") * F.log2(1 - p0)), F.col("p"))
    return p.select("row_id", arr(E.let(full, lambda a: E.let(E.array_sum(a) + 1e-12, lambda t: F.transform(a, lambda v: v / t)))).alias("p"))


@query("layered_regimes")
def layered_regimes(spark, sf):
    """Distance-quantile outliers and five cosine clusters, hard and soft."""
    data = V.features(spark, sf)
    model = C.fit_layers(data, "x", r=5, method="quantile", seeds=range(10))
    return C.with_layers(data, "x", model).select("row_id", F.col("label"), arr("p").alias("p"))


@query("layered_regimes_split")
def layered_regimes_split(spark, sf):
    """The same with the smaller of two clusters as outliers."""
    data = V.features(spark, sf)
    model = C.fit_layers(data, "x", r=5, method="kmeans", seeds=range(10))
    return C.with_layers(data, "x", model).select("row_id", F.col("label"), arr("p").alias("p"))


@query("kmeans_inertia")
def kmeans_inertia(spark, sf):
    table = C.inertias(V.features(spark, sf), "x", range(2, 11), seeds=range(10))
    return rnd(table, "inertia", digits=4)


@query("crisis_owner")
def crisis_owner(spark, sf):
    data = V.features(spark, sf)
    return spark.createDataFrame([(C.crisis_state(data, "x", "label"),)], "crisis_state int")


# ---- quality of a labeling ---------------------------------------------------------------------------------

_PTS = "SELECT m.month, s.universe, s.state, array_agg(m.value / 1e7 ORDER BY m.series_id) AS x FROM macro_monthly m JOIN states_monthly s USING (month) GROUP BY ALL"
_PAIR = "SELECT a.universe, a.month, a.state AS own, b.state AS other, list_distance(a.x, b.x) AS d FROM pts a JOIN pts b ON a.universe = b.universe"
_SUMM = "SELECT universe, month, own, other, sum(d) AS s, count(*) AS c FROM pair GROUP BY ALL"
_ROWS = "SELECT universe, month, own, max(s / nullif(c - 1, 0)) FILTER (own = other) AS a, min(s / c) FILTER (own <> other) AS b FROM summ GROUP BY ALL"


@query("silhouette", sql(f"SELECT universe, count(*) AS n, {r('avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END)')} AS silhouette FROM rws GROUP BY universe",
    "macro_monthly", "states_monthly", pts=_PTS, pair=_PAIR, summ=_SUMM, rws=_ROWS))
def silhouette(spark, sf):
    macro = V.macro_monthly(spark, sf).groupBy("month").agg(F.array_sort(F.array_agg(F.struct("series_id", (F.col("value") / 1e7).alias("v")))).alias("c"))
    points = macro.where(F.size("c") > 0).select("month", F.transform("c", lambda c: c["v"]).alias("x")).join(V.states_monthly(spark, sf), "month")
    return rnd(Q.silhouette(points, ["universe"], "month", "x", "state", n_blocks=2), "silhouette")


@query("seed_stability")
def seed_stability(spark, sf):
    """Agreement of diagonal mixtures from ten further seeds with that of seed 0."""
    data = V.features(spark, sf).select(F.col("row_id").alias("idx"), "x")
    fits = M.fit(data, [run for s in range(11) for run in M.restarts(str(s), 6, 10, seed=s)], covariance="diag")
    labels = M.score(data, list(fits.values())).select("idx", F.col("model").cast("int").alias("seed"), "label")
    return rnd(Q.seed_stability(labels, ["idx"], "seed", "label", 0), "ari_mean", "ari_std")


@query("chain_stability")
def chain_stability(spark, sf):
    """The same for hidden Markov chains, all seeds fitted in one job a step."""
    rows, blocks = hmm_inputs(spark, sf)
    chains = H.fit(blocks, H.numbered_rows(rows, ["entity", "date"]), [run for s in range(11) for run in H.restarts(str(s), 6, 1, s)])
    labels = H.decode(blocks, chains).select("seq", "date", F.col("model").cast("int").alias("seed"), F.col("state").alias("label"))
    return rnd(Q.seed_stability(labels, ["seq", "date"], "seed", "label", 0), "ari_mean", "ari_std")


# Tables after the fits, on labels that are plain functions of the data: seed s of a configuration cuts a value of the month differently.
_GRID = """SELECT 'c' || (p.feature % 3) AS config, CASE WHEN p.seed % 2 = 0 THEN 'GMM' ELSE 'HMM' END AS engine, CAST(p.seed // 2 AS INT) AS seed, p.month, CAST(floor(abs(m.value / 1e5) / (p.seed // 2 + 1 + p.feature)) % 3 AS BIGINT) AS state
    FROM (SELECT DISTINCT month, feature, seed FROM macro_monthly, range(3) f(feature), range(6) s(seed)) p JOIN macro_monthly m ON m.month = p.month AND m.series_id = 'TOTAL'"""
_PAIRED = "SELECT a.config, a.engine, a.seed, a.month, a.state AS s, b.state AS ref FROM grid_labels a JOIN grid_labels b ON a.config = b.config AND a.engine = b.engine AND a.month = b.month AND b.seed = 0 WHERE a.seed > 0"
_PAIRS = "sum(n::DOUBLE * (n - 1) / 2)"
_ARI = f"""SELECT config, engine, seed, (ab - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)) AS ari FROM (SELECT config, engine, seed, {_PAIRS} AS ab, sum(n)::DOUBLE AS n FROM (SELECT config, engine, seed, s, ref, count(*) AS n FROM paired GROUP BY ALL) GROUP BY ALL)
    JOIN (SELECT config, engine, seed, {_PAIRS} AS a FROM (SELECT config, engine, seed, s, count(*) AS n FROM paired GROUP BY ALL) GROUP BY ALL) USING (config, engine, seed) JOIN (SELECT config, engine, seed, {_PAIRS} AS b FROM (SELECT config, engine, seed, ref, count(*) AS n FROM paired GROUP BY ALL) GROUP BY ALL) USING (config, engine, seed)"""


def grid_labels(spark, sf):
    total = V.macro_monthly(spark, sf).where("series_id = 'TOTAL'").select("month", F.abs(F.col("value") / 1e5).alias("v"))
    each = total.withColumn("feature", F.explode(F.array(*map(F.lit, range(3))))).withColumn("s", F.explode(F.array(*map(F.lit, range(6)))))
    seed = F.floor(F.col("s") / 2).cast("int")
    state = (F.floor(F.col("v") / (seed + 1 + F.col("feature"))) % 3).cast("long")
    return each.select(F.concat(F.lit("c"), F.col("feature")).alias("config"), F.when(F.col("s") % 2 == 0, "GMM").otherwise("HMM").alias("engine"), seed.alias("seed"), "month", state.alias("state"))


@query("stability_by_config", sql(f"SELECT config, engine, {r('avg(ari)')} AS ari_mean, {r('stddev_pop(ari)')} AS ari_std, count(*) AS n_seeds FROM ari GROUP BY ALL", "macro_monthly", grid_labels=_GRID, paired=_PAIRED, ari=_ARI))
def stability_by_config(spark, sf):
    from tidepanel.plans.engines import stability

    return rnd(stability(grid_labels(spark, sf)), "ari_mean", "ari_std")


# The two dimensions of the distances: the month's total and one of its parts; their covariance with 1e-6 on the diagonal is inverted by hand.
_XY = "SELECT m.month, max(m.value) FILTER (series_id = 'TOTAL') / 1e6 AS x, max(m.value) FILTER (series_id = 'R|F') / 1e6 AS y FROM macro_monthly m GROUP BY month HAVING y IS NOT NULL"
_QUAD = """SELECT l.config, l.engine, l.month, l.state, ((x - mx) * (x - mx) * vy - 2 * (x - mx) * (y - my) * c + (y - my) * (y - my) * vx) / (vx * vy - c * c) AS q FROM (SELECT config, engine, month, state FROM grid_labels WHERE seed = 0) l JOIN xy USING (month),
    (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-6 AS vx, var_samp(y) + 1e-6 AS vy, covar_samp(x, y) AS c FROM xy)"""
_OWNER = "SELECT config, engine, state AS crisis FROM (SELECT config, engine, state, count(*) FILTER (q >= b) AS n FROM (SELECT *, quantile_cont(q, 0.85) OVER (PARTITION BY config, engine) AS b FROM quad) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY config, engine ORDER BY n DESC, state) = 1"
_CELLS = "SELECT config, engine, crisis, count(*) FILTER (state = crisis AND flag > 0) AS tp, count(*) FILTER (state = crisis AND flag = 0) AS fp, count(*) FILTER (state <> crisis AND flag > 0) AS fn FROM quad JOIN owner USING (config, engine) JOIN flag_monthly USING (month) GROUP BY ALL"
_RATES = "SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall FROM cells"


@query("detection_by_config", sql("SELECT config, engine, CAST(crisis AS INT) AS crisis, tp, fp, fn, recall, precision, round(coalesce(2 * recall * precision / nullif(recall + precision, 0), 0), 3) AS f1 FROM rates",
    "macro_monthly", "flag_monthly", grid_labels=_GRID, xy=_XY, quad=_QUAD, owner=_OWNER, cells=_CELLS, rates=_RATES))
def detection_by_config(spark, sf):
    """Crisis state by ownership of extreme months, and its recall and precision, for every configuration and engine at once."""
    from tidepanel.plans.engines import detection

    macro = V.macro_monthly(spark, sf)
    pick = lambda name: (F.max(F.when(F.col("series_id") == name, F.col("value"))) / 1e6)
    xy = macro.groupBy("month").agg(pick("TOTAL").alias("a"), pick("R|F").alias("b")).where("b is not null").select("month", F.array("a", "b").alias("x"))
    scores = xy.withColumn("config", F.explode(F.array(*[F.lit(f"c{i}") for i in range(3)])))
    first = grid_labels(spark, sf).where("seed = 0").drop("seed")
    return detection(first, scores, V.flag_monthly(spark, sf))


# ---- portfolios ------------------------------------------------------------------------------------------------

def backtest_feed(spark, sf):
    matrix = R.return_matrix(V.asset_returns(spark, sf), ["universe"])
    return matrix.join(V.states_monthly(spark, sf), ["universe", "month"])


def _pi():
    last = F.try_element_at("train", F.lit(-1))["state"]
    return F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda k: F.when(k == last, 0.8).otherwise(0.05))


@query("cvar_optimise")
def cvar_optimise(spark, sf):
    """Optimal weights of every window without regimes, with and without the penalty."""
    out = Z.backtest(backtest_feed(spark, sf), ["universe"], TRAIN, None, [0.02], strategies=["SAA", "DR"])
    return out.select("universe", "month", "strategy", arr("w").alias("w"), rounded("objective").alias("objective"), "success")


@query("cvar_optimise_l2")
def cvar_optimise_l2(spark, sf):
    out = Z.backtest(backtest_feed(spark, sf), ["universe"], TRAIN, None, [0.02], strategies=["DR"], norm="l2", max_weight=0.6)
    return out.select("universe", "month", "strategy", arr("w", 4).alias("w"), rounded("objective", 5).alias("objective"), "success")


def _certified(spark, sf, strategies, norm="l1", max_weight=1.0):
    """Every problem of a backtest once, with its proof; the duality gap is below 1e-8 where ``certified``."""
    todo = Z.problems(backtest_feed(spark, sf), ["universe"], TRAIN, K, [0.02, 0.1], pi=_pi(), strategies=strategies)
    todo = todo.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("universe", "month", "strategy", F.coalesce("gamma", F.lit(-1.0))))
    proved = Z.certificates(Z.optimise(todo, max_weight=max_weight, norm=norm, proof=True), max_weight=max_weight, norm=norm)
    within = F.coalesce(F.col("gap").between(-1e-9, 1e-8), F.lit(False))
    return proved.select("universe", "month", "strategy", "gamma", "success", "feasible", within.alias("certified"))


def _certificate_sql(cases):
    rows = ", ".join(f"('{s}', {'NULL' if g is None else g}::DOUBLE)" for s, g in cases)
    return sql(f"""SELECT universe, month, strategy, gamma, TRUE AS success, TRUE AS feasible, TRUE AS certified FROM (
        SELECT universe, month, row_number() OVER (PARTITION BY universe ORDER BY month) AS pos FROM return_matrix JOIN states_monthly USING (universe, month)),
        (VALUES {rows}) c(strategy, gamma) WHERE pos > {TRAIN}""", "return_matrix", "states_monthly")


@query("optimality_l1", _certificate_sql([("SAA", None), ("RS", None), ("DR", 0.02), ("DR", 0.1), ("RSDR", 0.02), ("RSDR", 0.1)]))
def optimality_l1(spark, sf):
    """Every solution behind ``cvar_optimise`` and the backtests is optimal: its multipliers leave no gap."""
    return _certified(spark, sf, list(Z.STRATEGIES))


@query("optimality_l2", _certificate_sql([("DR", 0.02), ("DR", 0.1), ("RSDR", 0.02), ("RSDR", 0.1)]))
def optimality_l2(spark, sf):
    """The same for the Euclidean penalty under a cap of 0.6."""
    return _certified(spark, sf, ["DR", "RSDR"], "l2", 0.6)


@query("backtest_four_strategies")
def backtest_four_strategies(spark, sf):
    out = Z.backtest(backtest_feed(spark, sf), ["universe"], TRAIN, K, [0.02, 0.1], pi=_pi())
    return rnd(out.select("universe", "gamma", "strategy", "month", "ret", "loss", "theta", "objective", "max_weight", "effective_n", "prev_state", "actual_state"),
               "ret", "loss", "theta", "objective", "max_weight", "effective_n")


@query("backtest_report")
def backtest_report(spark, sf):
    """Performance and turnover per universe, gamma and strategy, benchmarks behind them."""
    from tidepanel.session import cut_lineage

    results = cut_lineage(Z.backtest(backtest_feed(spark, sf), ["universe"], TRAIN, K, [0.02, 0.1], pi=_pi()))
    report = Z.backtest_report(results, V.asset_returns(spark, sf), ["universe"], single="1-URGENT")
    numbers = [c for c, t in report.dtypes if t == "double" and c != "gamma"]
    return rnd(report, *numbers)




@query("manifest")
def manifest(spark, sf):
    """Name and size of the input files; the content is not read."""
    from tidepanel.sources.readers import manifest as files

    return files(spark, sf, digest=False).drop("sha256")
