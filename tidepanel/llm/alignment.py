"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and which ids go together corpus-wide.

Side A is a byte-level BPE (read from its JSON, applied to a blank and the text), side B a BPE with byte fallback (which
adds the blank itself). Offsets in bytes at which tokens of both sides end cut the tokens into
groups; the two tokens that end there are linked.

Counting by spilled runs. A task gathers links up to a bound, sorts them by (part, B id, A id, document) and
writes, per part, the low bits of the B id, one run: its heads are the distinct pairs with their totals, in zstd frames,
and its records are the documents of every pair. Runs are merged on their heads with a k-way heap, at most
``FAN`` at a time and in as many levels as that takes, so a merge holds one frame of each run. The order is B id first:
when a B id's pairs are over, their largest count is known. The merged heads go back to the runs of
their part, a few runs at a time, where counts and maxima are added up by document. A pair that is very frequent is one
head of a run, its records stay in the run they were written in: no task holds all records of an id.

Cases: a text that is null or empty, or whose tokens of either side do not join to the blank and the text, has no
tokens: zeros and an empty digest; repeated rows are documents of their own; null ids stay null; texts of any length are
used whole; extra columns are not touched; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import sentencepiece
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

PARTS = 16
RUN_LINKS = 4_000_000
FAN = 64  # runs merged at once
TOGETHER = 16  # runs that get their counts back in one task
FRAME = 32_768
DOC_BITS = 16
CHUNK_BYTES = 1_000_000  # of text aligned at once
CACHE, CACHED_CHARS = 300_000, 64


class Vocabularies(NamedTuple):
    """The two vocabulary files as read, and the pattern that cuts texts for side A."""

    a: bytes
    b: bytes
    pattern: str


def byte_level_ranks(raw: bytes) -> dict[bytes, int]:
    """Bytes and ids of a byte-level BPE file; its merges must be in the order of the ids, so that ids are ranks."""
    spec = json.loads(raw)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    before = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("side A must be a plain byte-level BPE")
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
    if made != sorted(set(made)) or len(made) + 256 != len(vocab):
        raise ValueError("the merges of side A are not in the order of its ids")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {bytes(byte[c] for c in piece): i for piece, i in vocab.items()}


class PieceCache(dict):
    """Ids of a stretch of blanks and what follows up to the next blank, or None where they do not join to it."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> tuple[int, ...] | None:
        if len(self) >= CACHE:
            self.clear()
        ids = self.encode(chunk)
        if len(chunk) <= CACHED_CHARS:
            self[chunk] = ids
        return ids


class Tokens:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, files: Vocabularies):
        ranks = byte_level_ranks(files.a)
        self.encoding = tiktoken.Encoding("a", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        names = [self.pieces.id_to_piece(i) for i in range(len(self.pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.blank = self.pieces.piece_to_id("▁")
        # no piece goes on after a blank inside it, so texts may be cut before blanks and stretches encoded once
        probe = " two  stretches of   blanks "
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        self.cache = PieceCache(self.stretch)
        self.cuts = self.cuts and self.b_ids(probe) == self.pieces.encode(probe)

    def stretch(self, chunk: str) -> tuple[int, ...] | None:
        ids = self.pieces.encode(chunk[1:], num_threads=1) if len(chunk) > 1 else [self.blank]
        return tuple(ids) if b"".join(map(self.b_bytes.__getitem__, ids)) == chunk.encode() else None

    def b_ids(self, text: str) -> list[int] | None:
        """Side B of a blank and ``text``; None if its bytes differ."""
        if not self.cuts:
            ids = self.stretch(" " + text)
            return None if ids is None else list(ids)
        found = list(map(self.cache.__getitem__, re.findall(r" +[^ ]*", " " + text)))
        return None if None in found else list(chain.from_iterable(found))

    def both(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.empty(0, np.int64)
        ids = self.b_ids(text) if text else None
        if not ids:
            return none, none
        b = np.array(ids, np.int64)
        a = np.array(self.encoding.encode_to_numpy(" " + text, disallowed_special=()), np.int64)
        # tokens of side A are cut out of the text, so they join to it if their lengths do
        return (a, b) if self.a_size[a].sum() == self.b_size[b].sum() else (none, none)


_LOADED: dict[bytes, Tokens] = {}  # per Python worker


def loaded(files: Vocabularies) -> Tokens:
    key = hashlib.sha256(files.a + files.b + files.pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokens(files)
    return _LOADED[key]


class Aligned(NamedTuple):
    """Tokens of some documents one after the other; the k-th link is between tokens link_a[k] and link_b[k]."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_links: np.ndarray
    ends: np.ndarray  # byte offset of every link in its document


def aligned(tokens: Tokens, texts: list[str | None]) -> Aligned:
    pairs = [tokens.both(t) for t in texts]
    a, b = (np.concatenate([p[i] for p in pairs]) for i in (0, 1))
    n_a, n_b = (np.array([len(p[i]) for p in pairs], np.int64) for i in (0, 1))
    a_end, b_end = np.cumsum(tokens.a_size[a]), np.cumsum(tokens.b_size[b])
    size = int(a_end[-1]) if len(a) else 0
    ends = np.zeros((2, size + 1), bool)
    ends[0, a_end], ends[1, b_end] = True, True
    link_a, link_b = np.flatnonzero(ends[1, a_end]), np.flatnonzero(ends[0, b_end])
    doc = np.repeat(np.arange(len(texts)), n_a)[link_a]
    n_links = np.bincount(doc, minlength=len(texts))
    start = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(texts)), n_a), tokens.a_size[a], len(texts)).astype(np.int64)))
    return Aligned(a, b, n_a, n_b, link_a, link_b, n_links, a_end[link_a] - start[doc])


def written(tokens: Tokens) -> list[bytes]:
    """How tokens stand in a digest: an id of side A before "," or "|", then one of side B before "," or ";"."""
    a = chain.from_iterable((b"%d," % i, b"%d|" % i) for i in range(len(tokens.a_bytes)))
    b = chain.from_iterable((b"%d," % i, b"%d;" % i) for i in range(len(tokens.b_bytes)))
    return [*a, *b]


def digests(found: Aligned, table: list[bytes], n_a_ids: int) -> list[str]:
    """sha256 of every document's groups, "" without tokens."""
    last_a, last_b = np.zeros(len(found.a), np.int64), np.zeros(len(found.b), np.int64)
    last_a[found.link_a], last_b[found.link_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    codes = np.empty(len(found.a) + len(found.b), np.int64)
    codes[np.arange(len(found.a)) + np.append(0, found.link_b + 1)[group_a]] = 2 * found.a + last_a
    codes[np.arange(len(found.b)) + (found.link_a + 1)[group_b]] = 2 * (n_a_ids + found.b) + last_b
    ends = np.cumsum(found.n_a + found.n_b).tolist()
    codes = codes.tolist()
    return [
        hashlib.sha256(b"".join(map(table.__getitem__, codes[i:j]))[:-1]).hexdigest() if j > i else ""
        for i, j in zip([0, *ends], ends)
    ]


def chunked(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (id, text) in lists of about CHUNK_BYTES of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if size >= CHUNK_BYTES or len(held) >= 2_000:
            yield held
            held, size = [], 0
    if held:
        yield held


def squeezed(values: np.ndarray, kind: str = "<u4") -> bytes:
    """zstd of the values' bytes, the lowest bytes of all first."""
    raw = np.ascontiguousarray(values.astype(kind))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T).tobytes())


def opened(raw: bytes, kind: str = "<u4") -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind).astype(np.int64)


def framed(keys: np.ndarray, totals: np.ndarray) -> list[bytes]:
    """Heads (pair, total) in frames: two entries each."""
    out = []
    for i in range(0, len(keys), FRAME):
        out += [squeezed(keys[i : i + FRAME], "<u8"), squeezed(totals[i : i + FRAME], "<u8")]
    return out


def heads(frames: list[bytes]) -> Iterator[tuple[int, int]]:
    for i in range(0, len(frames), 2):
        yield from zip(opened(frames[i], "<u8").tolist(), opened(frames[i + 1], "<u8").tolist())


def all_heads(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([opened(f, "<u8") for f in frames[i::2]]) for i in (0, 1))


def merged(runs: list[list[bytes]]) -> list[bytes]:
    """The k-way merge of the runs' heads, equal pairs added up."""
    out, keys, totals, last = [], [], [], -1
    for key, total in heapq.merge(*map(heads, runs)):
        if key == last:
            totals[-1] += total
            continue
        if len(keys) >= FRAME:
            out += framed(np.array(keys), np.array(totals))
            keys, totals = [], []
        keys.append(key)
        totals.append(total)
        last = key
    return out + framed(np.array(keys, np.int64), np.array(totals, np.int64))


RUNS = "run long, part int, heads array<binary>, sizes binary, docs binary, times binary, doc_ids array<string>, counts array<array<long>>, digests array<string>"
_COLUMNS = [c.split()[0] for c in RUNS.split(", ")]


def runs(docs: DataFrame, files: Broadcast, run_links: int = RUN_LINKS, parts: int = PARTS) -> DataFrame:
    """The sorted runs of the links of ``docs`` (doc_id, text), and one row per run (part null) with its documents.

    ``files`` holds ``Vocabularies``. Runs are numbered as tasks meet them: store them before use.
    """

    def spill(run: int, bits: int, links: list[np.ndarray], rows: list[tuple]) -> pd.DataFrame:
        every = np.sort(np.concatenate(links)) if links else np.empty(0, np.uint64)
        records, times = np.unique(every, return_counts=True)
        pair, doc = (records >> np.uint64(DOC_BITS)).astype(np.int64), (records & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64)
        part, pair = pair >> 2 * bits, pair & ((1 << 2 * bits) - 1)
        cuts = np.searchsorted(part, np.arange(parts + 1))
        out = []
        for p, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                first = np.flatnonzero(np.append(True, pair[i + 1 : j] != pair[i : j - 1]))
                sizes = np.diff(np.append(first, j - i))
                frames = framed(pair[i:j][first], np.add.reduceat(times[i:j], first))
                out.append((run, p, frames, squeezed(sizes), squeezed(doc[i:j], "<u2"), squeezed(times[i:j]), None, None, None))
        out.append((run, None, None, None, None, None, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]))
        return pd.DataFrame(out, columns=_COLUMNS).astype({"part": "Int32"})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = loaded(files.value)
        table, bits = written(tokens), pair_bits(tokens)
        run, links, rows, n = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for held in chunked(zip(batch["doc_id"], batch["text"])):
                found = aligned(tokens, [t for _, t in held])
                a, b = found.a[found.link_a].astype(np.uint64), found.b[found.link_b].astype(np.uint64)
                doc = np.repeat(np.arange(len(rows), len(rows) + len(held)), found.n_links).astype(np.uint64)
                part = b & np.uint64(parts - 1)
                links.append(((((part << np.uint64(bits)) | b) << np.uint64(bits) | a) << np.uint64(DOC_BITS)) | doc)
                n += len(doc)
                counts = np.column_stack([found.n_a, found.n_b, found.n_links])
                rows += zip([None if pd.isna(i) else str(i) for i, _ in held], counts.tolist(), digests(found, table, len(tokens.a_bytes)))
                if n >= run_links or len(rows) > (1 << DOC_BITS) - 2_000:
                    yield spill(run, bits, links, rows)
                    run, links, rows, n = run + 1, [], [], 0
        if rows:
            yield spill(run, bits, links, rows)

    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(work, RUNS)


def pair_bits(tokens: Tokens) -> int:
    """Bits of an id in a pair; a pair, its part and its document fit 64 bits."""
    bits = max(len(tokens.a_bytes), len(tokens.b_bytes)).bit_length()
    if 2 * bits + DOC_BITS + (PARTS - 1).bit_length() > 64:
        raise ValueError("vocabularies too large")
    return bits


def counted(spilled: DataFrame, n_runs: int) -> DataFrame:
    """Per part the heads of all runs merged: part, heads."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        frames = [list(x) for x in rows["heads"]]
        return pd.DataFrame({"part": rows["part"][:1], "run": rows["run"][:1], "heads": [frames[0] if len(frames) == 1 else merged(frames)]})

    # new names for the columns: with one run nothing else tells them from the runs they will meet
    level = spilled.where("part is not null").select(*[F.col(c).alias(c) for c in ("part", "run", "heads")])
    while n_runs > 1:
        n_runs = -(-n_runs // FAN)
        dealt = level.select("part", F.pmod(F.xxhash64("run"), F.lit(n_runs)).alias("run"), "heads")
        level = stored(dealt.groupBy("part", "run").applyInPandas(merge, "part int, run long, heads array<binary>"))
    return level.select("part", "heads")


def pairs(spilled: DataFrame, files: Broadcast) -> DataFrame:
    """Corpus-wide links of every pair of ids: a, b, n, and whether n is the largest of its b."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = pair_bits(loaded(files.value))
        for batch in batches:
            for frames in batch["heads"]:
                key, n = all_heads(frames)
                yield pd.DataFrame({"a": key & ((1 << bits) - 1), "b": key >> bits, "n": n, "best": n == largest(key >> bits, n)})

    n_runs = spilled.where("part is null").count()
    return counted(spilled, n_runs).select("heads").mapInPandas(expand, "a long, b long, n long, best boolean")


def largest(b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For every pair the largest count of its B id; equal ids are neighbours."""
    first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    return np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(b))))


REPORT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def reported(docs: DataFrame, vocabularies: Vocabularies, run_links: int = RUN_LINKS) -> DataFrame:
    """One row per document: its tokens, groups and links, how many links are the best of their B id, and the sum of their counts."""
    files = docs.sparkSession.sparkContext.broadcast(vocabularies)  # two vocabulary files, a few MB whatever the corpus
    spilled = stored(runs(docs, files, run_links))
    n_runs = spilled.where("part is null").count()
    totals = counted(spilled, n_runs)
    slices = max(1, -(-n_runs // TOGETHER))

    def give_back(rows: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or totals.empty:
            return pd.DataFrame([], columns=["run", "best", "sums"])
        bits = pair_bits(loaded(files.value))
        key, count = all_heads(totals["heads"].iloc[0])
        best = count == largest(key >> bits, count)
        out = []
        for run, frames, sizes, doc, times in zip(rows["run"], rows["heads"], rows["sizes"], rows["docs"], rows["times"]):
            at = np.repeat(np.searchsorted(key, all_heads(frames)[0]), opened(sizes))
            doc, times = opened(doc, "<u2"), opened(times)
            sums, bests = np.zeros(doc.max() + 1, np.int64), np.zeros(doc.max() + 1, np.int64)
            np.add.at(sums, doc, times * count[at])
            np.add.at(bests, doc, times * best[at])
            out.append((run, bests.tobytes(), sums.tobytes()))
        return pd.DataFrame(out, columns=["run", "best", "sums"])

    slice_of = F.pmod(F.xxhash64("run"), F.lit(slices)).alias("slice")
    records = spilled.where("part is not null").select("run", "part", slice_of, "heads", "sizes", "docs", "times").groupBy("part", "slice")
    everywhere = totals.select("part", "heads", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice")).groupBy("part", "slice")
    given = records.cogroup(everywhere).applyInPandas(give_back, "run long, best binary, sums binary")

    def add_up(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["doc_ids"].notna()].iloc[0]
        n = len(own["doc_ids"])
        totals = np.zeros((2, n), np.int64)
        for best, sums in zip(rows["best"], rows["sums"]):
            if best is not None:
                for i, raw in enumerate((best, sums)):
                    part = np.frombuffer(raw, np.int64)
                    totals[i, : len(part)] += part
        counts = np.array([list(c) for c in own["counts"]], np.int64).reshape(n, 3)
        ids = pd.array([None if i is None else int(i) for i in own["doc_ids"]], "Int64")
        return pd.DataFrame({
            "doc_id": ids, "n_a": counts[:, 0], "n_b": counts[:, 1], "n_groups": counts[:, 2], "n_links": counts[:, 2],
            "n_best": totals[0], "count_sum": totals[1], "groups_sha256": list(own["digests"]),
        })

    own = spilled.where("part is null").select("run", "doc_ids", "counts", "digests", *[F.lit(None).cast("binary").alias(c) for c in ("best", "sums")])
    nothing = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("doc_ids", "counts", "digests")]
    return own.unionByName(given.select("run", *nothing, "best", "sums")).groupBy("run").applyInPandas(add_up, REPORT)


def groups(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """doc_id and the groups of every document: byte range in the blank and the text, ids of side A and of side B."""
    files = docs.sparkSession.sparkContext.broadcast(vocabularies)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = loaded(files.value)
        for batch in batches:
            for held in chunked(zip(batch["doc_id"], batch["text"])):
                rows = []
                for i, text in held:
                    found = aligned(tokens, [text])
                    split = zip(np.append(0, found.ends), found.ends, np.split(found.a, found.link_a + 1), np.split(found.b, found.link_b + 1))
                    rows.append((None if pd.isna(i) else int(i), [{"start": int(s), "end": int(e), "a": a, "b": b} for s, e, a, b in split]))
                yield pd.DataFrame(rows, columns=["doc_id", "groups"]).astype({"doc_id": "Int64"})

    kind = "doc_id long, groups array<struct<start: long, end: long, a: array<long>, b: array<long>>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(work, kind)
