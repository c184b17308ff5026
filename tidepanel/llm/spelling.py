"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and the form each one goes back to.

Two different words are near if their common prefix and suffix together reach the longer word's length minus one.
Dense tiling: a class holds the words of ``size`` code points and of one less. The size is cut
into ``SEGMENTS`` segments; an edit lies in one of them, so a near pair agrees before and behind some segment, the
prefix counted from the start and the suffix from the end. Words that agree there form a tile, whose
words stand in matrices of code points, padded once behind and once before, and are compared
block against block. A pair that meets in several tiles is taken in the first. A tile of more than ``TILE`` words is cut into blocks, and every pair
of blocks is compared in a place of its own.

Cases: a null or empty text, or one without letters, has no words; repeated rows count as often as they occur; a null
doc_id stands as an empty string before the colon; words of any length take part and texts are used whole; among near words of
the same count the smallest in code-point order is the form; extra columns are not touched; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
DROPPED = 199  # one run in so many loses a code point
SEGMENTS = 4
TILE = 4_096
BUCKET_ROWS = 100_000
HELD = 300_000  # different words counted before they are handed on
COMPARED_BYTES = 1 << 24
# Fixed value: letters are A-Z (lower-cased), a-z and U+00C0 to U+00FF; in Latin-1 a code point is a byte.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256))


def variants(doc_id: object, text: str | None) -> Iterator[tuple[bytes, int]]:
    """The words of a document in Latin-1 with their counts, code points deleted where the run's hash says so."""
    start = zlib.crc32(f"{'' if pd.isna(doc_id) else int(doc_id)}:".encode())
    letters = (text or "").encode("latin-1", "replace").translate(TO_WORDS)  # other characters become "?", no letter
    for run, n in Counter(letters.split()).items():
        if len(run) >= MIN_CHARS:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % DROPPED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < MIN_CHARS:
                    continue
            yield run, n


def word_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """word, n: words of MIN_CHARS code points or more that occur MIN_COUNT times or more in ``docs`` (doc_id, text)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        size = 0
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                for word, n in variants(i, text):
                    before = counts.get(word)
                    if before is None:
                        counts[word] = n
                        size += len(word)
                    else:
                        counts[word] = before + n
                if len(counts) >= held or size >= 64 * held:
                    yield _decoded(counts)
                    counts, size = {}, 0
        if counts:
            yield _decoded(counts)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(work, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _decoded(counts: dict[bytes, int]) -> pd.DataFrame:
    return pd.DataFrame({"word": [w.decode("latin-1") for w in counts], "n": np.fromiter(counts.values(), np.int64, len(counts))})


def cut(size, segment):
    """Start of a segment in a class; on columns or numbers."""
    return segment * size // SEGMENTS if isinstance(segment, int) and not isinstance(size, Column) else F.floor(segment * size / SEGMENTS).cast("int")


def tiles(words: DataFrame) -> DataFrame:
    """Every word in the tiles it belongs to: tile, size, segment, word, n."""
    classes = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    each = words.select("word", "n", classes).select("*", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("segment"))
    start, end = cut(F.col("size"), F.col("segment")), cut(F.col("size"), F.col("segment") + 1)
    behind = F.col("size") - end
    tail = F.when(behind > 0, F.substring("word", F.length("word") - behind + 1, behind)).otherwise(F.lit(""))
    return each.select(F.xxhash64("size", "segment", F.substring("word", F.lit(1), start), tail).alias("tile"), "size", "segment", "word", "n")


def blocked(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """``rows`` with unit and side: words of a unit are compared if they are of side 0, or of the sides 1 and 2."""
    large = rows.groupBy("tile").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > tile)
    marked = rows.join(large, "tile", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("members") / tile), F.lit(1)).cast("int"))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    met = marked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    unit = F.xxhash64("tile", F.least("own", "other"), F.greatest("own", "other"))
    return met.select(unit.alias("unit"), side.alias("side"), "size", "segment", "word", "n")


def common(matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows ``a`` and ``b``."""
    differ = matrix[a] != matrix[b]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), matrix.shape[1])


def near_pairs(words: list[bytes], size: int, unit: np.ndarray, side: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words of a class, rows sorted by unit; a pair only in the first segment that both its sides allow."""
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    ahead = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
    behind = np.frombuffer(b"".join(w[::-1].ljust(size, b"\0") for w in words), np.uint8).reshape(n, size)
    first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    end = np.repeat(np.append(first[1:], n), np.diff(np.append(first, n)))
    later = end - np.arange(n) - 1  # rows that every row meets
    starts, ends = cut_points(size)
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    total, most, row = np.cumsum(later), max(1, COMPARED_BYTES // size), 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + most, "right")))
        counts = later[row:stop]
        a = np.repeat(np.arange(row, stop), counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        meet = ((side[a] == 0) | (side[a] != side[b])) & (np.maximum(length[a], length[b]) == size)
        a, b = a[meet], b[meet]
        prefix, suffix = common(ahead, a, b), common(behind, a, b)
        shorter = np.minimum(length[a], length[b])
        prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
        near = (prefix + suffix >= size - 1) & (prefix < size)
        a, b, prefix, suffix = a[near], b[near], prefix[near], suffix[near]
        allowed = (prefix[:, None] >= starts) & (suffix[:, None] >= size - ends)
        here = allowed.argmax(axis=1) == segment[a]
        out.append((a[here], b[here]))
        row = stop
    return tuple(np.concatenate(x) for x in zip(*out))


def cut_points(size: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.array([cut(size, j) for j in range(SEGMENTS + 1)])
    return bounds[:-1], bounds[1:]


def near(words: DataFrame, tile: int = TILE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All ordered pairs of near words of ``words`` (word: distinct, n): word, near, near_n."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "unit"], kind="stable")
        out = []
        for size, own in rows.groupby("size", sort=False):
            unit = own["unit"].to_numpy()
            alone = np.append(True, unit[1:] != unit[:-1]) & np.append(unit[1:] != unit[:-1], True)
            own = own[~alone]
            if own.empty:
                continue
            words, n = own["word"].to_numpy(), own["n"].to_numpy()
            a, b = near_pairs([w.encode("latin-1") for w in words], int(size), unit[~alone], own["side"].to_numpy(), own["segment"].to_numpy())
            for x, y in ((a, b), (b, a)):
                out.append(pd.DataFrame({"word": words[x], "near": words[y], "near_n": n[y]}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["word", "near", "near_n"])

    rows = blocked(tiles(words), tile)
    buckets = int(words.count() * 2 * SEGMENTS // bucket_rows) + 1
    dealt = rows.withColumn("bucket", F.pmod("unit", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandas(compare, "word string, near string, near_n long")


def rooted(forms: DataFrame, rounds: int = 40) -> DataFrame:
    """word and root, from ``forms`` (word, form) followed to the end; counts grow along forms, so there are no circles."""
    at = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    for _ in range(rounds):
        if not at.where("moved").take(1):
            return at.select("word", "root")
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
    raise RuntimeError("forms do not end")


def grouped(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text)."""
    words = stored(word_counts(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    found = near(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(found, "word", "left")
    large = -F.col("best.less") >= RATIO * F.col("n")
    out = stored(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")))
    roots = rooted(out.where("form is not null"))
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
