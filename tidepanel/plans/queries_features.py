"""Feature preparation, screening and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.expr import rounded
from tidepanel.operators import features as J
from tidepanel.operators import panel as P
from tidepanel.plans import bundles as B
from tidepanel.plans import views as V
from tidepanel.plans.oracle_views import r, sql
from tidepanel.plans.queries_panel import rnd
from tidepanel.plans.registry import query

# ---- preparation ---------------------------------------------------------------------------------

@query("iqr_outliers", sql(f"""SELECT row_id, feature, CASE WHEN abs(value - quantile_cont(value, 0.5) OVER w) > 1.5 * (quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w) THEN NULL ELSE {r('value')} END AS value
    FROM features_long WINDOW w AS (PARTITION BY feature)""", "features_long"))
def iqr_outliers(spark, sf):
    """A tight fence, so that the test data has outliers."""
    return rnd(J.mask_outliers(V.features_long(spark, sf), ["feature"], "value", k=1.5).select("row_id", "feature", "value"), "value")


@query("zscore_pop", sql(f"SELECT row_id, feature, {r('(value - avg(value) OVER w) / stddev_pop(value) OVER w')} AS z FROM features_long WINDOW w AS (PARTITION BY feature)", "features_long"))
def zscore_pop(spark, sf):
    return rnd(J.standardise(V.features_long(spark, sf), ["feature"], "value").select("row_id", "feature", "z"), "z")


_HOLED = """SELECT m.month, s.series_id, s.tcode, CASE WHEN (month(m.month) = 5 AND s.tcode < 3) OR (s.tcode = 6 AND month(m.month) IN (2, 8)) THEN NULL ELSE v.value END AS v
    FROM (SELECT DISTINCT month FROM macro_monthly) m CROSS JOIN (SELECT DISTINCT series_id, tcode FROM macro_monthly) s LEFT JOIN macro_monthly v ON v.month = m.month AND v.series_id = s.series_id"""
_MW = "(PARTITION BY series_id ORDER BY month)"
_L = {k: f"lag(v, {k}) OVER {_MW}" for k in (1, 2)}
_CODED = f"""SELECT month, series_id, tcode, CASE tcode WHEN 1 THEN v WHEN 2 THEN v - {_L[1]} WHEN 3 THEN (v - {_L[1]}) - ({_L[1]} - {_L[2]}) WHEN 4 THEN ln(v) WHEN 5 THEN ln(v) - ln({_L[1]})
    WHEN 6 THEN (ln(v) - ln({_L[1]})) - (ln({_L[1]}) - ln({_L[2]})) WHEN 7 THEN (v / {_L[1]} - 1) - ({_L[1]} / {_L[2]} - 1) END AS x, row_number() OVER {_MW} AS n FROM holed"""
_MASK = """SELECT month, series_id, tcode, n, CASE WHEN abs(x - quantile_cont(x, 0.5) OVER s) > 2 * (quantile_cont(x, 0.75) OVER s - quantile_cont(x, 0.25) OVER s) THEN NULL ELSE x END AS x FROM coded
    WHERE n > 2 WINDOW s AS (PARTITION BY series_id)"""
_DENSE = "SELECT * FROM (SELECT *, count(x) OVER (PARTITION BY series_id) AS known, count(*) OVER (PARTITION BY series_id) AS rows, median(x) OVER (PARTITION BY series_id) AS med FROM mask) WHERE known >= floor(0.75 * rows)"
_SIDES = """SELECT *, last_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER b AS ln, last_value(x IGNORE NULLS) OVER b AS lv, first_value(CASE WHEN x IS NOT NULL THEN n END IGNORE NULLS) OVER a AS rn,
    first_value(x IGNORE NULLS) OVER a AS rv FROM dense WINDOW b AS (PARTITION BY series_id ORDER BY month), a AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


def holed_macro(spark, sf):
    gap = ((F.month("month") == 5) & (F.col("tcode") < 3)) | ((F.col("tcode") == 6) & F.month("month").isin(2, 8))
    return V.macro_monthly(spark, sf).withColumn("value", F.when(~gap, F.col("value")))


@query("prepare_features", sql(f"""SELECT month, series_id, {r('coalesce(CASE WHEN x IS NOT NULL THEN x WHEN ln IS NULL THEN rv WHEN rn IS NULL THEN lv ELSE lv + (rv - lv) * (n - ln) / (rn - ln) END, med)', 4)} AS value FROM sides""",
    "macro_monthly", holed=_HOLED, coded=_CODED, mask=_MASK, dense=_DENSE, sides=_SIDES))
def prepare_features(spark, sf):
    out = J.prepare(holed_macro(spark, sf), k=2.0, min_share=0.75)
    return rnd(out.select("month", "series_id", "value"), "value", digits=4)


def prepared_bundles(spark, sf):
    """Four bundles of macro, engineered and alternative series, prepared in one plan: ``(bundle, month, series_id, value)``."""
    from tidepanel.plans.queries_factors import MACRO_NAMES, monthly_closes

    closes = monthly_closes(spark, sf)
    macro = closes.where(F.col("series_id").isin(*MACRO_NAMES.values())).withColumn("tcode", F.lit(5))
    alt = V.macro_monthly(spark, sf).select("month", "series_id", "value", "tcode")
    from tidepanel.plans.engineered import engineered_features

    panel = B.bundles(macro, engineered_features(closes, names=MACRO_NAMES), alt, since="1995-01-01")
    return J.prepare(panel, bundle=["bundle"]).select("bundle", "month", "series_id", "value")


@query("feature_bundles")
def feature_bundles(spark, sf):
    return rnd(prepared_bundles(spark, sf), "value", digits=4)


# ---- components -------------------------------------------------------------------------------------

@query("pca_variance")
def pca_variance(spark, sf):
    """Explained and cumulative shares; invariants are checked in the tests."""
    model = J.fit_components(V.features(spark, sf), "x")
    table = J.loading_table(spark, model, [f"f{j:02d}" for j in range(len(model.mean))])
    return rnd(table.where(F.startswith("feature", F.lit("__"))), "value")


@query("pca_scores")
def pca_scores(spark, sf):
    data = V.features(spark, sf)
    scores = J.fit_components(data, "x").scores(data, "x")
    return scores.select("row_id", F.transform("scores", lambda v: rounded(v, 4)).alias("scores"))


@query("top_loadings")
def top_loadings(spark, sf):
    model = J.fit_components(V.features(spark, sf), "x")
    return rnd(J.top_loadings(J.loading_table(spark, model, [f"f{j:02d}" for j in range(len(model.mean))])), "value")


_CUMV = "SELECT feature, v / sum(v) OVER () AS ratio, sum(v) OVER (ORDER BY v DESC, feature ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS cum FROM (SELECT feature, var_pop(value) AS v FROM features_long GROUP BY ALL)"


@query("cumulative_share", sql(f"SELECT feature, {r('ratio')} AS ratio, {r('cum')} AS cum, CAST((SELECT count(*) FROM c WHERE cum < 0.95) + 1 AS BIGINT) AS n_keep FROM c", "features_long", c=_CUMV))
def cumulative_share(spark, sf):
    """Running share of variance over ranked features and the first position that reaches 95 %."""
    v = V.features_long(spark, sf).groupBy("feature").agg(F.var_pop("value").alias("v"))
    everything = P.Window.partitionBy()
    ranked = P.Window.orderBy(F.col("v").desc(), "feature").rowsBetween(P.Window.unboundedPreceding, 0)
    out = v.select("feature", (F.col("v") / F.sum("v").over(everything)).alias("ratio"), (F.sum("v").over(ranked) / F.sum("v").over(everything)).alias("cum"))
    keep = F.sum(F.when(F.col("cum") < 0.95, 1).otherwise(0)).over(everything) + 1
    return rnd(out.withColumn("n_keep", keep), "ratio", "cum")


# ---- screening ------------------------------------------------------------------------------------------

_PB = """SELECT feature, n, CASE WHEN n >= 10 AND sx > 0 AND sy > 0 THEN CASE WHEN abs(c) >= 1 THEN 'inf'::DOUBLE ELSE abs(c) * sqrt((n - 2) / (1 - c * c)) END ELSE 0 END AS t FROM (
    SELECT feature, count(*) AS n, corr(value, CASE WHEN label = 3 THEN 1.0::DOUBLE ELSE 0 END) AS c, stddev_pop(value) AS sx, stddev_pop(CASE WHEN label = 3 THEN 1.0::DOUBLE ELSE 0 END) AS sy FROM features_long GROUP BY ALL)"""


def screened(spark, sf):
    flagged = V.features_long(spark, sf).withColumn("flag", (F.col("label") == 3).cast("long"))
    return J.point_biserial(flagged, ["feature"], "value", "flag")


@query("point_biserial_screen", sql(f"SELECT feature, n, {r('t')} AS t, t > sqrt(2 * ln(count(*) OVER ())) AS hit FROM pb", "features_long", pb=_PB))
def point_biserial_screen(spark, sf):
    bound = F.sqrt(2.0 * F.log(F.count(F.lit(1)).over(P.Window.partitionBy())))
    return screened(spark, sf).select("feature", "n", rounded("t").alias("t"), (F.col("t") > bound).alias("hit"))


_F = """SELECT feature, (sum(n * pow(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS g FROM (
    SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM features_long GROUP BY ALL)) GROUP BY feature"""


@query("anova_f", sql(f"SELECT feature, {r('f', 5)} AS f FROM fs", "features_long", fs=_F))
def anova_f(spark, sf):
    return rnd(J.anova_f(V.features_long(spark, sf), ["feature"], "value", "label"), "f", digits=5)


_RANK = lambda c: f"rank() OVER (ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
_MR = f"SELECT feature, ({_RANK('f')} + {_RANK('t')}) / 2 AS mean_rank FROM (SELECT feature, {r('f', 5)} AS f, {r('t')} AS t FROM fs JOIN pb USING (feature))"


def ranked(spark, sf):
    both = anova_f(spark, sf).join(screened(spark, sf).select("feature", rounded("t").alias("t")), "feature")
    return J.mean_rank(both, "feature", ["f", "t"])


@query("mean_rank", sql("SELECT feature, mean_rank FROM mr", "features_long", fs=_F, pb=_PB, mr=_MR))
def mean_rank(spark, sf):
    return ranked(spark, sf)


@query("select_features", sql("SELECT feature, row_number() OVER (ORDER BY mean_rank, feature) AS position, mean_rank FROM mr QUALIFY position <= (SELECT greatest(count(*), 1) FROM pb WHERE t > sqrt(2 * ln(64)))",
    "features_long", fs=_F, pb=_PB, mr=_MR))
def select_features(spark, sf):
    """The screen sets how many features are kept, the mean rank which."""
    size = J.screen_size(screened(spark, sf), at_least=1)
    return J.select_top(ranked(spark, sf), size, "feature").withColumn("position", F.col("position").cast("long"))


@query("describe_features", sql("SELECT feature, CASE feature WHEN 0 THEN 'first component' WHEN 1 THEN 'second component' ELSE '' END AS description, mean_rank FROM mr", "features_long", fs=_F, pb=_PB, mr=_MR))
def describe_features(spark, sf):
    names = F.create_map(F.lit(0), F.lit("first component"), F.lit(1), F.lit("second component"))
    return ranked(spark, sf).select("feature", F.coalesce(names[F.col("feature").cast("int")], F.lit("")).alias("description"), "mean_rank")


@query("forest_importance")
def forest_importance(spark, sf):
    from tidepanel.operators.importance import forest_importance as run

    return rnd(run(V.features(spark, sf), "x", "label", seeds=[0, 1, 2]), "gini")


@query("permutation_importance")
def permutation_importance(spark, sf):
    from tidepanel.operators.importance import permutation_importance as run

    return rnd(run(V.features(spark, sf), "x", "label", seed=0, repeats=3), "drop")


@query("importance_mean_rank")
def importance_mean_rank(spark, sf):
    """Mean rank of impurity, permutation and F importance."""
    from tidepanel.operators.importance import ranked_features

    return rnd(ranked_features(V.features(spark, sf), V.features_long(spark, sf)), "mean_rank")


