"""Regime engines over feature configurations: selection, components, fits and their figures, all keyed by configuration.

Every step treats all configurations at once: one pass folds their covariances, one job a step fits
both engines' runs (configurations, seeds, restarts), and the tables after the fits are grouped by model.
The fitted parts are tables or small arrays: ``Chain`` holds them in the order in which they are made.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import clusters as C
from tidepanel.operators import evaluate as Q
from tidepanel.operators import features as J
from tidepanel.operators import hmm as H
from tidepanel.operators import importance as I
from tidepanel.operators import mixture as M
from tidepanel.operators import regimes as G
from tidepanel.operators.passes import Span, pooled


@dataclass(frozen=True)
class Config:
    """A feature table for the engines: a bundle, whole or with the features the screen and the mean rank select."""

    name: str
    bundle: str
    selected: bool = False


# The five monthly configurations; selections are ranked against regimes of the bundle below.
CONFIGS = [
    Config("macro+eng", "macro+eng"),
    Config("comb_all/all", "comb"),
    Config("comb_all/bn_meanrank", "comb", True),
    Config("altdata_full/all", "alt"),
    Config("altdata_full/bn_meanrank", "alt", True),
]
LABEL_BUNDLE = "macro"


def vectors(long: DataFrame, key: str, row: str = "month", feature: str = "series_id", value: str = "value") -> DataFrame:
    """``(key, row, x)``: the values of a row in the order of the features' names; rows that lack one drop out."""
    width = long.select(key, feature).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_width"))
    cells = long.where(F.col(value).isNotNull()).groupBy(key, row).agg(F.array_sort(F.array_agg(F.struct(feature, value))).alias("_c"))
    whole = cells.join(width, key).where(F.size("_c") == F.col("_width"))
    return whole.select(key, row, F.transform("_c", lambda c: c[value]).alias("x"))


def reference_labels(long: DataFrame, until: str, regimes: int = 5, seeds: Sequence[int] = range(10)) -> DataFrame:
    """Layered regimes ``(month, label)`` of one bundle's component scores up to a date."""
    rows = vectors(long.withColumn("_b", F.lit("")), "_b")
    scores = J.fit_components(rows, "x").scores(rows, "x").where(F.col("month") <= F.lit(until).cast("date")).select("month", "scores")
    held, view, _ = pooled(scores)
    labelled = C.with_layers(view, "scores", C.fit_layers(view, "scores", r=regimes, seeds=list(seeds))).select("month", "label").persist()
    labelled.count()
    held.unpersist()
    return labelled


def screen(long: DataFrame, flag: DataFrame, until: str) -> DataFrame:
    """Per bundle how many features pass the screen against the flag: ``(bundle, k, n_features)``."""
    known = long.where(F.col("month") <= F.lit(until).cast("date")).join(flag, "month")
    return J.screen_size(J.point_biserial(known, ["bundle", "series_id"], "value", "flag"), keys=["bundle"], at_least=1)


def ranks(long: DataFrame, labels: DataFrame, bundles: Sequence[str], seeds: Sequence[int] = (0, 1, 2), repeats: int = 3, trees: int = 200, depth: int = 30) -> DataFrame:
    """Mean rank of every feature of the given bundles: ``(bundle, series_id, mean_rank)``."""
    known = J.standardise(long.where(F.col("bundle").isin(*bundles)), ["bundle", "series_id"], "value").join(labels, "month").select("bundle", "month", "series_id", F.col("z").alias("value"), "label")
    rows = vectors(known, "bundle").join(labels, "month").persist()
    importances = None
    for bundle in bundles:
        own = I.tree_scores(rows.where(F.col("bundle") == bundle), "x", "label", seeds, repeats, trees, depth).withColumn("bundle", F.lit(bundle))
        importances = own if importances is None else importances.unionByName(own)
    rows.unpersist()
    numbered = known.select("bundle", "series_id").distinct().groupBy("bundle").agg(F.array_sort(F.collect_set("series_id")).alias("names"))
    numbered = numbered.select("bundle", F.posexplode("names").alias("feature", "series_id"))
    f = J.anova_f(known, ["bundle", "series_id"], "value", "label")
    joined = importances.join(numbered, ["bundle", "feature"]).join(f, ["bundle", "series_id"])
    return J.mean_rank(joined, "series_id", ["gini", "drop", "f"], runs=["seed"], keys=["bundle"])


def configured(long: DataFrame, chosen: DataFrame | None, configs: Sequence[Config]) -> DataFrame:
    """The long table of every configuration: ``(config, month, series_id, value)``; ``chosen`` names features per bundle."""
    out = None
    for selected in (False, True):
        own = [c for c in configs if c.selected == selected]
        if not own:
            continue
        named = F.explode(F.array(*[F.struct(F.lit(c.name).alias("config"), F.lit(c.bundle).alias("of")) for c in own]))
        part = long.withColumn("_c", named).where("_c.of = bundle")
        part = part.join(chosen.select("bundle", "series_id"), ["bundle", "series_id"], "left_semi") if selected else part
        part = part.select(F.col("_c.config").alias("config"), "month", "series_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Chain:
    """Fitted parts of all configurations, and the labels of both engines from every seed."""

    features: DataFrame  # config, n_feat, n_pcs
    components: dict[str, J.Components]
    scores: DataFrame  # config, month, x
    mixtures: dict[str, M.Mixture]  # "config|seed"
    chains: H.Models
    labels: DataFrame  # config, engine, seed, month, state


def fit_chain(long: DataFrame, configs: Sequence[Config] = CONFIGS, chosen: DataFrame | None = None, k: int = 6, n_init: int = 10, seeds: tuple[int, int] = (10, 10),
              hmm_iter: int = 20) -> Chain:
    """Components and both engines of every configuration; ``seeds`` are the further seeds of the mixtures and of the chains."""
    rows = vectors(configured(long, chosen, configs), "config")
    spark = long.sparkSession
    kept, rows, _ = pooled(rows)
    components = J.fit_components_by(rows, "x", "config")
    sizes = [(name, len(m.mean), len(m.ratio)) for name, m in components.items()]
    features = spark.createDataFrame(sizes, "config string, n_feat int, n_pcs int")
    scores = J.component_scores(rows, "x", components, "config").select("config", "month", F.col("scores").alias("x"), F.xxhash64("month").alias("idx")).persist()
    scores.count()
    kept.unpersist()

    names = list(components)
    runs = [r for c in names for s in range(seeds[0] + 1) for r in M.restarts(f"{c}|{s}", k, n_init, s, Span(config=c))]
    mixtures = M.fit(scores, runs, covariance="diag")
    model = F.split("model", r"\|")
    both = [F.array_join(F.slice(model, 1, F.size(model) - 1), "|").alias("config"), F.element_at(model, -1).cast("int").alias("seed")]
    mixed = M.score(scores, list(mixtures.values()), keep=["month"]).select(*both, F.lit("GMM").alias("engine"), "month", F.col("label").alias("state"))

    blocks = H.stored(H.to_blocks(scores, "config", "month", "x", width=366, config="config"))
    chains = H.fit(blocks, scores, [r for c in names for s in range(seeds[1] + 1) for r in H.restarts(f"{c}|{s}", k, 1, s, c)], max_iter=hmm_iter)
    path = H.decode(blocks, chains).select(*both, F.lit("HMM").alias("engine"), F.col("date").alias("month"), "state")
    labels = mixed.unionByName(path).persist()
    labels.count()
    blocks.unpersist()
    return Chain(features, components, scores.select("config", "month", "x"), mixtures, chains, labels)


def detection(labels: DataFrame, scores: DataFrame, flag: DataFrame, keys: Sequence[str] = ("config", "engine")) -> DataFrame:
    """Crisis state and detection figures of every labelling ``(keys, month, state)``."""
    keys = list(keys)
    named = labels.join(scores, ["config", "month"]).withColumn("_model", F.concat_ws("|", *keys))
    crisis = C.crisis_states(named, "x", "state", "_model")
    flagged = named.select(*keys, "_model", "month", "state").join(crisis, "_model").join(flag, "month")
    return G.detection(flagged, F.col("state") == F.col("crisis"), F.col("flag") > 0, [*keys, "crisis"])


def stability(labels: DataFrame, keys: Sequence[str] = ("config", "engine"), reference: int = 0) -> DataFrame:
    """Agreement of every further seed's labels with the reference seed's: ``(keys, ari_mean, ari_std, n_seeds)``."""
    return Q.seed_stability(labels, ["month"], "seed", "state", reference, keys)


def criteria(chain: Chain) -> DataFrame:
    """``(config, engine, bic)`` of the fits of seed 0."""
    rows = [(name.rpartition("|")[0], engine, float(m.bic())) for engine, fits in (("GMM", chain.mixtures), ("HMM", chain.chains)) for name, m in fits.items() if name.endswith("|0")]
    return chain.labels.sparkSession.createDataFrame(rows, "config string, engine string, bic double")


def diagnostics(chain: Chain, flag: DataFrame, n_blocks: int = 1) -> DataFrame:
    """One row per configuration and engine: sizes, silhouette, BIC, agreement of seeds, crisis state and detection figures."""
    keys = ["config", "engine"]
    first = chain.labels.where("seed = 0").drop("seed")
    quality = Q.silhouette(first.join(chain.scores, ["config", "month"]), keys, "month", "x", "state", n_blocks).select(*keys, "silhouette")
    found = detection(first, chain.scores, flag)
    out = criteria(chain).join(chain.features, "config").join(quality, keys).join(stability(chain.labels), keys).join(found, keys)
    n_rec = (F.col("tp") + F.col("fn")).alias("n_rec")  # flagged months the labels cover
    return out.select("config", "engine", "n_feat", "n_pcs", "silhouette", "bic", "ari_mean", "ari_std", "n_seeds", "crisis", n_rec, "recall", "precision", "f1")


def select_features(long: DataFrame, flag: DataFrame, until: str, configs: Sequence[Config] = CONFIGS, label_bundle: str = LABEL_BUNDLE, **forest) -> DataFrame:
    """Screen size and mean rank of every bundle that a configuration selects from: ``(bundle, series_id, position, mean_rank)``.

    Only months up to ``until`` are looked at.
    """
    bundles = list(dict.fromkeys(c.bundle for c in configs if c.selected))
    seen = long.where(F.col("month") <= F.lit(until).cast("date"))
    labels = reference_labels(long.where(F.col("bundle") == label_bundle), until)
    ranked = ranks(seen, labels, bundles, **forest)
    return J.select_top(ranked, screen(long.where(F.col("bundle").isin(*bundles)), flag, until), "series_id", ["bundle"])
