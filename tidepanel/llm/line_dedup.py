"""Line dedup: lines within a few edits of each other form a class, of which the first occurrence stays.

Segment-partition join: a line is cut into TAU + 1 segments, one of which survives TAU
edits; shorter or equally long lines probe the segments with the few substrings whose place
allows it (both sides of a match within the edits left for them). Lines that share a segment
key meet, letter counts rule most pairs out inside the join, and a banded bit-parallel edit
distance decides. Equal lines are one line throughout, so copies never meet each other.

All of it is column expressions. Cases: a null text has no lines; lines below MIN_CHARS
stand for themselves and are never removed; a text of any length is split whole; rows that
share a doc_id but not their text are documents of their own, equal rows are one; rows without doc_id are left as they are; other
columns pass through; an empty table gives an empty table. A line is named by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import col, components, fresh, stored

TAU, MIN_CHARS = 2, 20
LETTERS = "aeinorst"


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, line_no (from 0), line and its name, for lines long enough to be judged."""
    # outer forms throughout: the plain ones evaluate their array once more, for a filter on its size
    rows = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
    return rows.where(F.length("line") >= min_chars).withColumn("lid", F.xxhash64("line"))


def segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of k: the last ones take the remainder."""
    base, spare = F.floor(length / k).cast("int"), (length % k).cast("int")
    return i * base + F.greatest(F.lit(i - k) + spare, F.lit(0)), base + F.when(spare >= k - i, 1).otherwise(0)


def segment_keys(tau: int) -> Column:
    """Keys of a line's own segments."""
    n = F.col("size")
    keys = []
    for i in range(tau + 1):
        start, size = segment(n, i, tau + 1)
        keys.append(F.xxhash64(n, F.lit(i), F.substring(F.col("line"), start + 1, size)))
    return F.array(*keys)


def probe_keys(tau: int, min_chars: int) -> Column:
    """Keys of the substrings that can equal a segment of a line up to ``tau`` shorter; null where none fits."""
    n = F.col("size")
    keys = []
    for shorter in range(tau + 1):
        m = n - shorter
        for i in range(tau + 1):
            start, size = segment(m, i, tau + 1)
            for shift in range(-tau, tau + 1):
                if abs(shift) <= i and abs(shift - shorter) <= tau - i:
                    at = start + shift
                    fits = (m >= min_chars) & (at >= 0) & (at + size <= n)
                    keys.append(F.when(fits, F.xxhash64(m, F.lit(i), F.substring(F.col("line"), at + 1, size))))
    return F.array(*keys)


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def common_prefix(a: Column, b: Column, limit: Column) -> Column:
    """Characters that two strings share at the front, at most ``limit``: halving steps."""
    start = F.struct(a.alias("a"), b.alias("b"), limit.alias("limit"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        same = (s["n"] + k <= s["limit"]) & (F.substring(s["a"], s["n"] + 1, k) == F.substring(s["b"], s["n"] + 1, k))
        return F.struct(s["a"].alias("a"), s["b"].alias("b"), s["limit"].alias("limit"), (s["n"] + F.when(same, k).otherwise(0)).alias("n"))

    highest = F.least(F.floor(F.log2(F.greatest(limit, F.lit(1)).cast("double"))).cast("int") + 1, F.lit(30))  # one more than needed, as log2 rounds
    powers = F.transform(F.sequence(highest, F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(powers, start, step)["n"]


def close(a: Column, b: Column, tau: int) -> Column:
    """Whether two strings are within ``tau`` edits: what differs between their common ends decides.

    Of the middle's pieces, all but ``tau`` must be found in the other middle at nearly the
    same place; only then, or when the middle is short, is the distance computed.
    """
    pieces = 4 * (tau + 1)

    def middles(w: Column) -> Column:
        front = common_prefix(w["a"], w["b"], w["short"])
        return bound(F.struct(w["a"].alias("a"), w["b"].alias("b"), w["short"].alias("short"), front.alias("front")), tails)

    def tails(w: Column) -> Column:
        back = common_prefix(F.reverse(w["a"]), F.reverse(w["b"]), w["short"] - w["front"])
        ends = F.struct(w["a"].alias("a"), w["b"].alias("b"), w["front"].alias("front"), back.alias("back"))
        return bound(ends, lambda v: bound(F.struct(
            F.substring(v["a"], v["front"] + 1, F.length(v["a"]) - v["front"] - v["back"]).alias("x"),
            F.substring(v["b"], v["front"] + 1, F.length(v["b"]) - v["front"] - v["back"]).alias("y"),
        ), decided))

    def decided(v: Column) -> Column:
        x, y = F.when(F.length(v["x"]) >= F.length(v["y"]), v["x"]).otherwise(v["y"]), F.when(F.length(v["x"]) >= F.length(v["y"]), v["y"]).otherwise(v["x"])
        return bound(F.struct(x.alias("x"), y.alias("y"), F.floor(F.length(x) / pieces).cast("int").alias("k")), judged)

    def judged(v: Column) -> Column:
        found = F.lit(0)
        for i in range(pieces):
            piece = F.substring(v["x"], i * v["k"] + 1, v["k"])
            begin = F.greatest(i * v["k"] - tau, F.lit(0))
            found = found + F.when(F.instr(F.substring(v["y"], begin + 1, v["k"] + 2 * tau), piece) > 0, 1).otherwise(0)
        return (F.length(v["x"]) <= tau) | (((v["k"] < 2) | (found >= pieces - tau)) & within(v["x"], v["y"], tau))

    return bound(F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("short")), middles)


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether the edit distance of two strings, the first longer than ``tau`` and not the shorter one, is at most ``tau``.

    One word of 2 tau + 2 bits follows the diagonal: bit k stands for the row tau - top + k
    from it. Down to the last row the distance grows along the diagonal, then along the row.
    """
    top = 2 * tau + 1
    mask = (1 << (top + 1)) - 1
    # the state carries the characters: an expression inside the step would be evaluated at every step
    start = F.struct(
        F.split(a, "").alias("chars"), F.length(a).alias("m"),
        F.lit(((1 << (tau + 1)) - 1) << (top - tau)).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("dist"), F.lit(0).alias("at"),
    )
    inverse = lambda x: F.bitwise_not(x).bitwiseAND(F.lit(mask))

    def step(s: Column, c: Column) -> Column:
        vp, vn, i = s["vp"], s["vn"], s["at"]
        match = F.lit(0)
        for k in range(top + 1):
            match = match + F.when(F.get(s["chars"], i + (tau - top + k)) == c, 1 << k).otherwise(0)
        # several expressions use the same words, so each is bound once as the only element of an array
        return F.element_at(F.transform(F.array(F.struct(match.alias("x"), vp.alias("vp"), vn.alias("vn"))), lambda w: second(s, w)), 1)

    def second(s: Column, w: Column) -> Column:
        d0 = ((w["x"].bitwiseAND(w["vp"]) + w["vp"]).bitwiseAND(F.lit(mask)).bitwiseXOR(w["vp"])).bitwiseOR(w["x"]).bitwiseOR(w["vn"])
        return F.element_at(F.transform(F.array(d0), lambda d: third(s, w, d)), 1)

    def third(s: Column, w: Column, d0: Column) -> Column:
        hp, hn = w["vn"].bitwiseOR(inverse(d0.bitwiseOR(w["vp"]))), d0.bitwiseAND(w["vp"])
        down = F.shiftright(d0, 1)
        along = s["at"] - (s["m"] - tau)  # columns since the band reached the last row
        bit = lambda x, k: F.call_function("shiftright", x, k).bitwiseAND(F.lit(1))
        place = F.greatest(F.lit(top - 1) - along, F.lit(0))
        grown = F.when(along < 0, 1 - bit(d0, F.lit(top))).otherwise(bit(hp, place) - bit(hn, place))
        return F.struct(
            s["chars"].alias("chars"), s["m"].alias("m"),
            hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["dist"] + grown).alias("dist"), (s["at"] + 1).alias("at"),
        )

    return (F.abs(F.length(a) - F.length(b)) <= tau) & (F.aggregate(F.split(b, ""), start, step)["dist"] <= tau)


def line_links(lines: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs (a, b) of names of different lines within ``tau`` edits; ``lines`` has lid and line, one row per lid."""
    sized = lines.withColumn("size", F.length("line"))
    # a projection evaluates what its expressions share once; within the generator they would not share it
    own = sized.select("lid", segment_keys(tau).alias("keys")).select("lid", F.explode_outer("keys").alias("key"))
    probes = sized.select("lid", probe_keys(tau, min_chars).alias("keys")).select("lid", F.explode_outer("keys").alias("key")).where("key is not null")
    meets = lambda x, y: x.alias("x").join(y.alias("y"), F.expr("x.key = y.key and x.lid <> y.lid"), "left_semi")
    members = meets(own, probes).withColumn("own", F.lit(True)).unionByName(meets(probes, own).withColumn("own", F.lit(False)))
    count = lambda letters: F.length("line") - F.length(F.translate("line", letters, ""))
    counts = F.array(*[count(x) for x in LETTERS])
    few = stored(members.join(lines, "lid").select("key", "own", "lid", "line", counts.alias("counts"), count("abcdefghijklm").alias("half")))
    # the count of half the letters differs by at most tau: busy keys fall apart into windows of it
    window = F.floor(F.col("half") / (tau + 1))
    left = few.where("own").select("key", "lid", "line", "counts", F.explode_outer(F.array(window - 1, window, window + 1)).alias("window")).alias("x")
    right = few.where("not own").select("key", "lid", "line", "counts", window.alias("window")).alias("y")
    near = F.expr("x.key = y.key and x.window = y.window and x.lid <> y.lid")
    for i in range(len(LETTERS)):
        near &= F.abs(F.col("x.counts")[i] - F.col("y.counts")[i]) <= tau
    near &= close(F.col("x.line"), F.col("y.line"), tau)  # decided inside the join: only links are rows
    return left.join(right, near).select(F.least("x.lid", "y.lid").alias("a"), F.greatest("x.lid", "y.lid").alias("b")).distinct()


def row_name(docs: DataFrame) -> Column:
    """What tells rows apart and orders them: the doc_id, and where rows share one (one small count finds out) the text's hash behind it."""
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)
    return F.struct(F.col("doc_id"), F.xxhash64("text").alias("text")) if shared else F.col("doc_id")


def removals(docs: DataFrame, name: Column, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """row (its ``name``), removed (line numbers), n_near (removed lines whose text has no earlier equal), for rows that lose a line."""
    rows = occurrences(docs.where("doc_id is not null").select(name.alias("doc_id"), "text"), min_chars)
    lines = rows.groupBy("lid").agg(F.first("line").alias("line"))
    links = stored(line_links(lines, tau, min_chars))
    roots = components(links).withColumnRenamed("node", "lid")
    places = rows.select("doc_id", "line_no", "lid")
    seen = places.groupBy("lid").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    classes = seen.join(roots, "lid", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "lid"))
    keepers = classes.groupBy("root").agg(F.min("first_doc").alias("keep_doc"))
    known = classes.join(keepers, "root").select("lid", "root", "first_doc", "keep_doc")
    per = places.join(known, "lid").groupBy("doc_id", "root", "keep_doc").agg(
        F.collect_set("line_no").alias("nos"), F.size(F.collect_set(F.when(F.col("first_doc") == F.col("doc_id"), F.col("lid")))).alias("firsts"),
    )
    keeps = F.col("doc_id") == F.col("keep_doc")
    removed = F.when(keeps, F.array_except("nos", F.array(F.array_min("nos")))).otherwise(F.col("nos"))
    per = per.select("doc_id", removed.alias("removed"), (F.col("firsts") - F.when(keeps, 1).otherwise(0)).alias("near")).where(F.size("removed") > 0)
    return per.groupBy(F.col("doc_id").alias("row")).agg(F.array_sort(F.flatten(F.collect_list("removed"))).alias("removed"), F.sum("near").cast("long").alias("n_near"))


def reported(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, removed_lines of every document."""
    name = row_name(docs)
    table = removals(docs.select("doc_id", "text"), name)
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out = docs.select("doc_id", lines.alias("n_lines"), name.alias("row")).join(table, "row", "left")
    return out.select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.array_join(F.transform("removed", lambda i: i.cast("string")), ","), F.lit("")).alias("removed_lines"),
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without the removed lines; a document left without any word goes, unless it had none before."""
    removed, row = fresh(docs, "removed", "row")
    name = row_name(docs)
    table = removals(docs.select("doc_id", "text"), name).select(F.col("row").alias(row), F.col("removed").alias(removed))
    out = docs.withColumn(row, name).join(table, row, "left").select(*[col(c) for c in docs.columns], removed)
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(removed), i)), "\n")
    out = out.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.where(F.col(removed).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).drop(removed)
