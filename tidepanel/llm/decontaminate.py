"""Benchmark decontamination: a distributed positional inverted index of the documents, asked for benchmark phrases.

Index. Documents are dealt into segments of about a million words. A segment stores, for every
term, the sorted places of its tokens: ``index`` gives rows (segment, part, terms, counts,
places), where part is the range of the term's hash and the last three are packed arrays, and
one row per segment with the ids and sizes of its documents. A frequent term has one list per segment, so no task ever
holds all its postings.

Search. A window is ``width`` consecutive words of an item (a shorter item is one window).
Only the lists of benchmark terms leave the index. Their lengths, added up over all segments,
order the terms of each window from the rarest; a window goes to the segments that hold its rarest term. There
the lists, each moved by its term's offset, are intersected from the rarest on: what is left are the exact
phrases. For proximity the lists are intersected with a tolerance, and every shortest stretch of at most
``width + slack`` words that holds all the window's different words, in any order, is a match.

Cases: a null text, or one without words, has no words and is hit by nothing, an item of this kind has no window; null ids
stay null (an item's is left out of the list of ids); repeated rows of documents are documents of their own, repeated items
count once; texts of any length are used whole, windows do not cross documents; extra columns
are not touched; an empty table on either side gives no match. Terms are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

WIDTH, SLACK = 10, 5
PARTS = 64
SEGMENT_WORDS = 1_000_000
CACHE = 400_000
BROADCAST_TERMS = 1_000_000  # 8 MB of hashes; more benchmark terms than these are joined by part
SLICE_WINDOWS = 200_000
# Fixed value: a word is a run of other characters than \x00-\x2F, \x3A-\x60 and \x7B-\x7F, after A-Z became a-z.
TO_WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Names(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def term_names(text: str | None, names: Names) -> np.ndarray:
    words = (text or "").encode().translate(TO_WORDS).split()
    return np.fromiter(map(names.__getitem__, words), np.uint64, len(words))


def part_of(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - (PARTS.bit_length() - 1))).astype(np.int64)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def spread(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every n of ``lengths``, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


INDEX = "segment long, part long, doc_ids array<long>, sizes array<long>, terms binary, counts binary, places binary"


def index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text). Segments are numbered as tasks meet them: store it before use."""

    def pack(segment: int, ids: list, terms: list[np.ndarray]) -> pd.DataFrame:
        all_terms = np.concatenate(terms)
        places = np.argsort(all_terms, kind="stable")
        first, counts = runs_of(ordered := all_terms[places])
        distinct = ordered[first]
        cuts = np.searchsorted(part_of(distinct), np.arange(PARTS + 1))
        ends = np.append(first, len(places))
        rows = [
            (segment, p, None, None, distinct[i:j].tobytes(), counts[i:j].astype(np.int32).tobytes(), places[ends[i] : ends[j]].astype(np.int32).tobytes())
            for p, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i
        ]
        rows.append((segment, None, ids, [len(t) for t in terms], None, None, None))
        out = pd.DataFrame(rows, columns=["segment", "part", "doc_ids", "sizes", "terms", "counts", "places"])
        return out.astype({"part": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, ids, terms, size = Names(), [], [], 0
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                ids.append(None if pd.isna(i) else int(i))
                terms.append(term_names(text, names))
                size += len(terms[-1]) + 1
                if size >= segment_words:
                    yield pack(segment, ids, terms)
                    segment, ids, terms, size = segment + 1, [], [], 0
        if ids:
            yield pack(segment, ids, terms)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, INDEX)


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id (text), at (words from 0) and the terms of every different window of ``items`` (item_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Names()
        for batch in batches:
            for i, text in zip(batch["item_id"], batch["text"]):
                terms = term_names(text, names).view(np.int64)
                for start in range(0, len(terms), 10_000):  # a long item goes out in pieces
                    ats = range(start, min(start + 10_000, max(len(terms) - width, 0) + 1))
                    yield pd.DataFrame({"item_id": [i] * len(ats), "at": np.array(ats, np.int64), "terms": [terms[a : a + width] for a in ats]})

    rows = items.select(F.col("item_id").cast("string"), "text").mapInPandas(run, "item_id string, at long, terms array<long>")
    return rows.distinct()


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """The lists of ``terms`` (term: distinct) in every segment: segment, terms, counts, places as in the index."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"][:1], "wanted": [np.sort(rows["term"].to_numpy().view(np.uint64)).tobytes()]})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for segment, wanted, held, counts, places in zip(batch["segment"], batch["wanted"], batch["terms"], batch["counts"], batch["places"]):
                wanted, held, counts = np.frombuffer(wanted, np.uint64), np.frombuffer(held, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                at = at[held[at] == wanted]
                if len(at):
                    n = counts[at]
                    taken = np.frombuffer(places, np.int32)[np.repeat((np.cumsum(counts) - counts)[at], n) + spread(n)]
                    rows.append((segment, held[at].tobytes(), n.astype(np.int32).tobytes(), taken.tobytes()))
            yield pd.DataFrame(rows, columns=["segment", "terms", "counts", "places"])

    number = terms.count()
    part = F.shiftrightunsigned("term", 64 - (PARTS.bit_length() - 1))
    packed = terms.select(part.alias("part"), "term").groupBy("part").applyInPandas(pack, "part long, wanted binary")
    lists = index.where("part is not null").select("segment", "part", "terms", "counts", "places")
    if number <= BROADCAST_TERMS:
        both = lists.join(F.broadcast(packed), "part")
    else:  # the rows of a part are very many: they meet in as many places as there are parts
        salts = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        both = lists.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(PARTS)).cast("int")).join(salts, ["part", "salt"])
    return both.select("segment", "wanted", "terms", "counts", "places").mapInPandas(find, "segment long, terms binary, counts binary, places binary")


class Lists:
    """The lists of a segment: every place of term number t as t * 2^32 + place, in order, and its documents' first places."""

    def __init__(self, rows: pd.DataFrame, sizes: np.ndarray):
        join = lambda c, t: np.frombuffer(b"".join(rows[c]), t)
        terms, counts, places = join("terms", np.uint64), join("counts", np.int32).astype(np.int64), join("places", np.int32).astype(np.int64)
        order = np.argsort(terms)
        starts = (np.cumsum(counts) - counts)[order]
        self.terms, self.n = terms[order], counts[order]
        self.start = np.cumsum(self.n) - self.n
        self.keys = places[np.repeat(starts, self.n) + spread(self.n)] + (np.repeat(np.arange(len(terms)), self.n) << 32)
        self.docs = np.append(0, np.cumsum(sizes))

    def number(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def places(self, t: int) -> np.ndarray:
        return self.keys[self.start[t] : self.start[t] + self.n[t]] & 0xFFFFFFFF

    def next_of(self, t: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of term ``t`` that is not before ``place``; 2^40 if there is none."""
        at = np.searchsorted(self.keys, (t << 32) + place)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == t), key & 0xFFFFFFFF, 1 << 40)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.docs, place, "right") - 1


def chunks(candidates: np.ndarray, most: int = 2_000_000) -> Iterator[slice]:
    """Slices of windows with at most ``most`` candidates, or one window."""
    total, start = np.cumsum(candidates), 0
    while start < len(candidates):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        yield slice(start, end)
        start = end


def phrases(lists: Lists, numbers: np.ndarray, offsets: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (row of ``numbers``) and places where their terms stand one after the other.

    ``numbers`` and ``offsets`` hold the terms of a window from the rarest on, padded by -1.
    """
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for part in chunks(lists.n[numbers[:, 0]]):
        own, off = numbers[part], offsets[part]
        n = lists.n[own[:, 0]]
        window = np.repeat(np.arange(len(own)), n)
        start = (lists.keys[np.repeat(lists.start[own[:, 0]], n) + spread(n)] & 0xFFFFFFFF) - off[window, 0]
        keep = (start >= 0) & (lists.doc(np.maximum(start, 0)) == lists.doc(start + length[part][window] - 1))
        window, start = window[keep], start[keep]
        for r in range(1, own.shape[1]):
            term, place = own[window, r], start + off[window, r]
            keep = (term < 0) | (lists.next_of(np.maximum(term, 0), place) == place)
            window, start = window[keep], start[keep]
        out.append((window + part.start, start))
    return tuple(np.concatenate(x) for x in zip(*out))


def stretches(lists: Lists, numbers: np.ndarray, span: np.ndarray) -> list[tuple[int, int, int]]:
    """(window, first, last place) of every shortest stretch of at most ``span`` words with all the terms of a window."""
    out = set()
    for part in chunks(lists.n[numbers[:, 0]]):
        own = numbers[part]
        n = lists.n[own[:, 0]]
        window = np.repeat(np.arange(len(own)), n)
        place = lists.keys[np.repeat(lists.start[own[:, 0]], n) + spread(n)] & 0xFFFFFFFF
        doc, reach = lists.doc(place), span[part][window]
        low, high = np.maximum(place - reach + 1, lists.docs[doc]), np.minimum(place + reach, lists.docs[doc + 1])
        for r in range(1, own.shape[1]):
            term = own[window, r]
            keep = (term < 0) | (lists.next_of(np.maximum(term, 0), low) < high)
            window, place, low, high = window[keep], place[keep], low[keep], high[keep]
        for w, p, lo, hi in zip(window.tolist(), place.tolist(), low.tolist(), high.tolist()):
            terms = np.unique(own[w][own[w] >= 0])
            each = [lists.places(t) for t in terms.tolist()]
            starts = np.unique(np.concatenate([q[np.searchsorted(q, lo) : np.searchsorted(q, p, "right")] for q in each])).tolist()
            end = lambda s: int(lists.next_of(terms, np.full(len(terms), s)).max())  # noqa: B023, E731
            for s in starts:
                if p <= (e := end(s)) < min(hi, s + int(span[part][w])) and end(s + 1) > e:
                    out.add((w + part.start, s, e))
    return sorted(out)


MATCHES = "segment long, doc int, item_id string, kind string, item_at long, doc_at long, words long"


def matches(index: DataFrame, items: DataFrame, width: int = WIDTH, slack: int | None = SLACK) -> DataFrame:
    """Where windows of ``items`` (item_id, text) occur in the indexed documents.

    ``doc`` counts the segment's documents from 0, ``item_at`` and ``doc_at`` count words. Rows of kind "phrase" join the
    windows of an item that follow each other in item and document; rows of kind "near"
    (unless ``slack`` is None) are the shortest stretches with all the words of one window.
    """
    asked = stored(windows(items, width))
    lists = stored(postings(index, asked.select(F.explode("terms").alias("term")).distinct()))

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for segment, terms, counts in zip(batch["segment"], batch["terms"], batch["counts"]):
                yield pd.DataFrame({"segment": segment, "term": np.frombuffer(terms, np.int64), "n": np.frombuffer(counts, np.int32).astype(np.int64)})

    found = lists.select("segment", "terms", "counts").mapInPandas(lengths, "segment long, term long, n long")
    totals = found.groupBy("term").agg(F.sum("n").alias("total"))
    each = asked.select("item_id", "at", "terms", F.posexplode("terms").alias("offset", "term")).join(totals, "term")
    ranked = each.groupBy("item_id", "at", "terms").agg(F.sort_array(F.collect_list(F.struct("total", "offset", "term"))).alias("rank"))
    whole = ranked.where(F.size("rank") == F.size("terms")).select("item_id", "at", F.col("rank.offset").alias("offsets"), F.col("rank.term").alias("terms"))
    sent = whole.withColumn("term", F.col("terms")[0]).join(found.select("segment", "term"), "term").drop("term")
    busiest = sent.groupBy("segment").count().agg(F.max("count")).first()[0] or 0
    slices = int(busiest // SLICE_WINDOWS) + 1
    sent = sent.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))
    sizes = index.where("part is null").select("segment", "sizes", *[F.lit(None).cast("binary").alias(c) for c in ("terms", "counts", "places")])
    held = lists.select("segment", F.lit(None).cast("array<long>").alias("sizes"), "terms", "counts", "places").unionByName(sizes).withColumn("slice", every)

    def intersect(held: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in MATCHES.split(", ")]
        packed = held[held["terms"].notna()]
        if sent.empty or packed.empty:
            return pd.DataFrame([], columns=columns)
        segment = int(sent["segment"].iloc[0])
        lists = Lists(packed, np.asarray(held["sizes"][held["terms"].isna()].iloc[0], np.int64))
        length = sent["terms"].map(len).to_numpy()
        shape = np.arange(width) < length[:, None]
        numbers, offsets = np.full(shape.shape, -1), np.zeros(shape.shape, np.int64)
        numbers[shape] = lists.number(np.concatenate(sent["terms"].to_list()).view(np.uint64))
        offsets[shape] = np.concatenate(sent["offsets"].to_list())
        here = ((numbers >= 0) | ~shape).all(axis=1)
        numbers, offsets, length = numbers[here], offsets[here], length[here]
        item, at = sent["item_id"].to_numpy()[here], sent["at"].to_numpy()[here]
        rows: list[tuple] = []
        window, start = phrases(lists, numbers, offsets, length)
        code = pd.factorize(item, use_na_sentinel=False)[0][window] if len(window) else window
        order = np.lexsort((at[window], start - at[window], code))
        window, start, code = window[order], start[order], code[order]
        if len(window):
            same = (code[1:] == code[:-1]) & (np.diff(start) == 1) & (np.diff(at[window]) == 1)
            first = np.flatnonzero(np.append(True, ~same))
            last = np.append(first[1:], len(window)) - 1
            doc = lists.doc(start[first])
            words = start[last] - start[first] + length[window[last]]
            rows += zip([segment] * len(first), doc, item[window[first]], ["phrase"] * len(first), at[window[first]], start[first] - lists.docs[doc], words)
        if slack is not None:
            for w, s, e in stretches(lists, numbers, length + slack):
                doc = int(lists.doc(np.array([s]))[0])
                rows.append((segment, doc, item[w], "near", at[w], s - lists.docs[doc], e - s + 1))
        return pd.DataFrame(rows, columns=columns)

    return held.groupBy("segment", "slice").cogroup(sent.groupBy("segment", "slice")).applyInPandas(intersect, MATCHES)


def reported(docs: DataFrame, items: DataFrame, width: int = WIDTH, slack: int | None = SLACK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row of ``docs``.

    Hit are the words inside an occurrence of a window; ``n_near`` counts the items with a proximity match.
    """
    table = stored(index(docs))
    found = stored(matches(table, items, width, slack))
    end, key = F.col("doc_at") + F.col("words"), ["segment", "doc"]
    before = F.max("end").over(Window.partitionBy(*key).orderBy("doc_at", "end").rowsBetween(Window.unboundedPreceding, -1))
    exact = found.where("kind = 'phrase'").select(*key, "doc_at", end.alias("end"))
    covered = exact.withColumn("before", F.coalesce(before, F.lit(0))).groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("doc_at", "before"))).alias("n_hit"))
    named = F.collect_set(F.when(F.col("kind") == "phrase", F.col("item_id")))
    items_of = found.groupBy(*key).agg(named.alias("items"), F.countDistinct(F.when(F.col("kind") == "near", F.col("item_id"))).alias("n_near"))
    each = F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("doc", "row")
    rows = table.where("part is null").select("segment", each).select("segment", "doc", F.col("row.doc_ids").alias("doc_id"), F.col("row.sizes").alias("n_words"))
    out = rows.join(items_of, key, "left").join(covered, key, "left")
    items_, hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(items_)), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
