"""Exact top-k search by a three-phase uniform threshold.

The dimensions are dealt over BLOCKS nodes, each of which knows one part of every score.
Phase one: every node's list of best parts per query; the exact scores of the listed
vectors give a safe cutoff, as that many rows reach it. Phase two: entries of at least
cutoff / BLOCKS are gathered; a score that reaches the cutoff has such a part, so anything
unseen lies below it. What could still reach the cutoff has its missing parts resolved
exactly in phase three.

Vectors and queries are dealt into groups by hash, so that a cell (node, group of vectors,
group of queries) is one bounded matrix product, whatever the sizes of the two sides. Equal
vectors are one vector with its k + 1 smallest ids, so copies are never compared.

Cases: null vectors, empty ones and those with a null, NaN or infinite component take no
part; vectors only meet those of their own length; ties go to the smaller id; repeated ids
count as one row each; fewer candidates than k give fewer rows; an empty table gives no
rows; other columns are not touched. Scores are exact while sums of products stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

SCALE, BLOCKS = 256, 2
LISTED = 32  # length of a node's list per query: longer lists give a closer cutoff
CELL = ["dim", "node", "g", "h"]
ENTRY = "dim int, node int, g int, h int, c long, vec long, part double"


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and q, the whole-number components, of rows that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where("vec_id is not null and embedding is not null").where(sound & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("q"))


def _group(column: str, groups: int):
    return F.pmod(F.xxhash64(column), F.lit(groups)).cast("int")


def _packed(df: DataFrame, key: str, group: str, groups: int, name: str) -> DataFrame:
    """One row per node and group: the names and the matrix of the node's dimensions."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        matrix, ids = np.stack(rows["q"].to_numpy()).astype(np.float64), rows["c"].to_numpy(np.int64).tobytes()
        dim = matrix.shape[1]
        return pd.DataFrame([
            {"dim": dim, "node": b, group: int(rows[group].iloc[0]), f"{name}_ids": ids, name: matrix[:, part].tobytes()}
            for b, part in enumerate(np.array_split(np.arange(dim), BLOCKS))
        ])

    rows = df.select(F.col(key).alias("c"), "q", F.size("q").alias("dim"), _group(key, groups).alias(group))
    return rows.groupBy("dim", group).applyInPandas(pack, f"dim int, node int, {group} int, {name}_ids binary, {name} binary")


def _parts(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the vectors and of the queries of a cell, and the parts of their scores."""
    ids, qids = np.frombuffer(row["v_ids"], np.int64), np.frombuffer(row["w_ids"], np.int64)
    return ids, qids, np.frombuffer(row["w"]).reshape(len(qids), -1) @ np.frombuffer(row["v"]).reshape(len(ids), -1).T


def _entries(row, query: np.ndarray, vec: np.ndarray, part: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({**{k: row[k] for k in CELL}, "c": query, "vec": vec, "part": part})


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phase one: the best parts of every query in a cell."""
    for batch in batches:
        for _, row in batch.iterrows():
            vec, query, part = _parts(row)
            m = min(LISTED, len(vec))
            top = np.argpartition(-part, m - 1, axis=1)[:, :m]
            yield _entries(row, np.repeat(query, m), vec[top].ravel(), np.take_along_axis(part, top, 1).ravel())


def _above(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phase two: parts that reach their share of the query's cutoff."""
    for batch in batches:
        for _, row in batch.iterrows():
            vec, query, part = _parts(row)
            share = pd.Series(np.frombuffer(row["shares"]), np.frombuffer(row["share_ids"], np.int64)).reindex(query).to_numpy()
            i, j = np.nonzero(part >= share[:, None])
            yield _entries(row, query[i], vec[j], part[i, j])


def _looked_up(asked: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
    """The parts of the pairs a cell is asked for."""
    row = cell.iloc[0]
    ids, qids = np.frombuffer(row["v_ids"], np.int64), np.frombuffer(row["w_ids"], np.int64)
    v, w = np.frombuffer(row["v"]).reshape(len(ids), -1), np.frombuffer(row["w"]).reshape(len(qids), -1)
    i, j = pd.Index(qids).get_indexer(asked["c"]), pd.Index(ids).get_indexer(asked["vec"])
    part = np.empty(len(i))
    for at in range(0, len(i), 65536):
        s = slice(at, at + 65536)
        part[s] = np.einsum("ij,ij->i", w[i[s]], v[j[s]])
    return _entries(row, asked["c"].to_numpy(), asked["vec"].to_numpy(), part)


def _scores(known: DataFrame, cells: DataFrame) -> DataFrame:
    """c, vec, score from c, vec, known (the sum of ``nodes``), with the parts of the other nodes looked up."""
    place = ["dim", "g", "h", "c", "vec"]
    others = F.array_except(F.array(*[F.lit(b) for b in range(BLOCKS)]), "nodes")
    asked = known.select(*place, F.explode(others).alias("node"))
    found = asked.groupBy(*CELL).cogroup(cells.groupBy(*CELL)).applyInPandas(lambda a, c: _looked_up(a, c) if len(a) else pd.DataFrame(columns=[x.split()[0] for x in ENTRY.split(", ")]), ENTRY)
    both = known.select("c", "vec", F.col("known").alias("part")).unionByName(found.select("c", "vec", "part"))
    return both.groupBy("c", "vec").agg(F.sum("part").cast("long").alias("score"))


def _known(entries: DataFrame) -> DataFrame:
    return entries.groupBy("dim", "g", "h", "c", "vec").agg(F.sum("part").alias("known"), F.collect_set("node").alias("nodes"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, vectors_each: int = 8192, queries_each: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose id is divisible by ``every``."""
    depth = k + 1  # a query's own row may be among its best
    rows = quantized(vectors).withColumn("name", F.xxhash64("q"))
    by_id = Window.partitionBy("name", "q").orderBy("vec_id")
    first = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= depth).select("name", "q", "vec_id")
    ids = stored(first.groupBy("name", "q").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("c", F.element_at("ids", 1)))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "name", "q")
    named = stored(asked.join(ids.select("name", "q", "c"), ["name", "q"]).select(F.col("vec_id").alias("query_id"), "c", "q"))
    wanted = named.select("c", "q").dropDuplicates(["c"])
    g, h = (max(1, -(-n // each)) for n, each in ((ids.count(), vectors_each), (named.count(), queries_each)))
    of_vectors, of_queries = stored(_packed(ids, "c", "g", g, "v")), stored(_packed(wanted, "c", "h", h, "w"))
    # a group of vectors goes to every group of queries and the other way round
    spread_v = of_vectors.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    spread_w = of_queries.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    cells = spread_v.join(spread_w, CELL)

    # phase one: local lists, and the exact scores of what they name
    local = cells.mapInPandas(_listed, ENTRY)
    best = F.row_number().over(Window.partitionBy("c", "node").orderBy(F.desc("part"), "vec"))
    heads = stored(_known(local.withColumn("r", best).where(F.col("r") <= LISTED)))
    nth = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "vec"))
    reached = _scores(heads, cells).withColumn("r", nth).where(F.col("r") <= depth).groupBy("c").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    cutoffs = stored(reached.select("c", F.when(F.col("n") == depth, F.col("low").cast("double")).otherwise(float("-inf")).alias("cutoff")))

    # phase two: entries that reach their share of the cutoff
    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"h": int(rows["h"].iloc[0]), "share_ids": rows["c"].to_numpy(np.int64).tobytes(), "shares": (rows["cutoff"].to_numpy(np.float64) / BLOCKS).tobytes()}])

    shares = cutoffs.withColumn("h", _group("c", h)).groupBy("h").applyInPandas(bound, "h int, share_ids binary, shares binary")
    bounded = spread_v.join(spread_w.join(shares, "h"), CELL)
    seen = _known(bounded.mapInPandas(_above, ENTRY)).join(cutoffs, "c")
    # phase three: what can reach the cutoff is resolved exactly
    missing = BLOCKS - F.size("nodes")
    open_ = stored(seen.where((missing == 0) | (F.col("known") + missing * F.col("cutoff") / BLOCKS >= F.col("cutoff"))))
    scores = _scores(open_, cells).join(cutoffs, "c").where(F.col("score") >= F.col("cutoff"))
    top = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "vec"))
    # equal scores of different vectors: their ids decide, and each vector's smallest is its name
    few = scores.withColumn("r", top).where(F.col("r") <= depth).select("c", "vec", "score")
    scored = few.join(ids.select(F.col("c").alias("vec"), "ids"), "vec").select("c", F.explode("ids").alias("vec_id"), "score")
    order = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("score"), "vec_id"))
    best_of = scored.withColumn("r", order).where(F.col("r") <= depth).drop("r")
    out = named.select("query_id", "c").join(best_of, "c").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
