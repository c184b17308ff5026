"""N-gram Jaccard join: sets of word shingles within a distance of 0.2, as connected groups.

Regions. Unlike texts all lie at distance 1 from each other, so cells around sampled texts
would leave nearly everything in one cell. Regions are therefore anchored at single shingles:
in the order of document frequency, rarest first, two sets within the distance share one of
their first (1 - 0.8) n + 1 shingles, so a set enters the regions of those that another set
also holds. Inside a region, the smallest set is the
pivot, every member's distance to it is computed exactly, and members near it are linked to it.
Sets that links connect have one root, and a region of one root is done. Sets of the other
regions fall into cells by their smallest pivot; a large cell is cut into rings by distance
and rings into blocks. Blocks that meet in a region are compared as matrices, set by set, but
not those of one cell whose rings the triangle inequality keeps apart. A set travels once with
every pair of blocks, not with every pair of sets. No pair of different roots is lost, and
copies are never paired with each other: equal sets are one set throughout.

Frequencies are counted by ranges of the hash, packed into binary columns, so that no task
holds more than a range. A set only travels on when enough of its shingles occur elsewhere.

Cases: a null text or one without words has an empty set, linked with nothing; fewer words
than a shingle make one shingle; repeated rows are equal sets; a text of any length is used
whole; other columns are not touched; an empty table gives an empty table. Shingles are
named by 62 bits of a hash or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import components, fresh, stored

WIDTH, PERCENT = 5, 80
# Odd multipliers of the shingle hash.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
CACHE = 150_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: WordHash) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    tokens = (text or "").encode().lower().split()  # on bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) < WIDTH:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), seed=len(tokens))], np.uint64)
    one = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = len(one) - WIDTH + 1
    mixed = one[:n] * ODD[0]
    for j in range(1, WIDTH):
        mixed = (mixed ^ (mixed >> np.uint64(32))) * ODD[j] + one[j : j + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= ODD[0]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def name_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


PACKED = "part long, ids binary, sizes binary, counts binary, hashes binary"
ROWS = "docs binary, known binary"  # of a row that only says which set every document has: ids and sizes by document
BYTES = 7  # of a hash that travel; its first bits are the part's number


def _packed(part: int, ids, sizes, counts, hashes, **more) -> dict:
    raw = {"ids": ids, "sizes": sizes, "counts": counts, "hashes": hashes, **more}
    return {"part": part, **{k: v.tobytes() for k, v in raw.items()}}


def _shortened(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The BYTES after the first ``bits`` of every hash."""
    return np.ascontiguousarray((hashes << np.uint64(bits)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :])


def _lengthened(raw: bytes, part: int, bits: int) -> np.ndarray:
    whole = np.zeros((len(raw) // BYTES, 8), np.uint8)
    whole[:, 8 - BYTES :] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return (whole.reshape(-1).view("<u8") >> np.uint64(bits)) | np.uint64(part << (64 - bits))


def dealt(docs: DataFrame, parts: int, flush: int = 500_000) -> DataFrame:
    """Every set's shingles by ranges of the hash, a task sends a set once; beside them every document's set."""
    bits = parts.bit_length() - 1

    def pack(held: list[tuple[int, np.ndarray]]) -> list[dict]:
        hashes = np.concatenate([s for _, s in held])
        owner = np.repeat(np.arange(len(held)), [len(s) for _, s in held])
        ids, sizes = np.array([i for i, _ in held], np.int64), np.array([len(s) for _, s in held], np.int32)
        part = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(part.astype(np.uint16) if bits <= 16 else part, kind="stable")
        part, owner, hashes = part[order], owner[order], hashes[order]
        short, rows = _shortened(hashes, bits), []
        bounds = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)]
        for i, j in zip(bounds, bounds[1:]):
            counts = np.bincount(owner[i:j], minlength=len(held))
            own = np.flatnonzero(counts)
            rows.append(_packed(int(part[i]), ids[own], sizes[own], counts[own].astype(np.int32), short[i:j]))
        return rows

    def listed(of: list[tuple]) -> dict:
        docs_, ids, sizes = zip(*of)
        known = np.array([d is not None for d in docs_])
        numbers = np.array([0 if d is None else d for d in docs_], np.int64)
        mixed = xxhash.xxh3_64_intdigest(numbers.tobytes())  # any part will do
        return _packed(mixed % parts, np.array(ids, np.int64), np.array(sizes, np.int32), np.empty(0, np.int32), np.empty(0, np.uint8), docs=numbers, known=known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen, held, size, of = WordHash(), set(), [], 0, []
        frame = lambda: pd.DataFrame([*(pack(held) if held else []), listed(of)], columns=["part", "ids", "sizes", "counts", "hashes", "docs", "known"])
        for batch in batches:
            for d, t in zip(batch["doc"].tolist(), batch["text"]):
                s = shingle_set(t, words)
                i = name_of(s)
                of.append((int(d) if isinstance(d, str) else None, i, len(s)))
                if len(s) and i not in seen:
                    seen.add(i)
                    held.append((i, s))
                    size += len(s)
                if size >= flush or len(of) >= flush // 4:
                    yield frame()
                    held, size, of = [], 0, []
        if of:
            yield frame()

    named = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc"), "text")  # as text, so that nulls and long numbers stay
    return named.mapInPandas(run, f"{PACKED}, {ROWS}")


def _joined(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def shared_shingles(packed: DataFrame, parts: int) -> DataFrame:
    """Sets of which enough shingles occur in another set (set_id, n, hashes: rarest first), and every document's set (set_id, n, doc_id; hashes null)."""
    bits = parts.bit_length() - 1

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        listed, rows = rows[rows["docs"].notna()].assign(freqs=None), rows[rows["docs"].isna()]
        ids, sizes, counts = _joined(rows["ids"], np.int64), _joined(rows["sizes"], np.int32), _joined(rows["counts"], np.int32)
        hashes = np.concatenate([np.empty(0, np.uint64), *[_lengthened(raw, int(part), bits) for part, raw in zip(rows["part"], rows["hashes"])]])
        first = np.zeros(len(ids), bool)
        first[np.unique(ids, return_index=True)[1]] = True  # a set that several tasks sent counts once
        hashes, owner = hashes[np.repeat(first, counts)], np.repeat(np.arange(len(ids), dtype=np.int32), np.where(first, counts, 0))
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        start = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        freq = np.diff(np.append(np.flatnonzero(start), len(hashes)))[np.cumsum(start) - 1].astype(np.int32)
        keep = freq > 1
        hashes, owner, freq = hashes[keep], owner[keep], freq[keep]
        to = (ids.astype(np.uint64) * ODD[1] >> np.uint64(40)).astype(np.int64) % parts
        part = to[owner]
        order = np.lexsort((owner, part))
        hashes, owner, freq, part = hashes[order], owner[order], freq[order], part[order]
        out = []
        bounds = (np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []) + [len(part)]
        for i, j in zip(bounds, bounds[1:]):
            new = np.flatnonzero(np.append(True, owner[i + 1 : j] != owner[i : j - 1]))
            each = np.diff(np.append(new, j - i)).astype(np.int32)
            own = owner[i:j][new]
            out.append(_packed(int(part[i]), ids[own], sizes[own], each, hashes[i:j], freqs=freq[i:j]))
        return pd.concat([listed, pd.DataFrame(out, columns=["part", "ids", "sizes", "counts", "hashes", "freqs"])]).astype(object).where(lambda x: x.notna(), None)

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        listed, rows = rows[rows["docs"].notna()], rows[rows["docs"].isna()]
        numbers, known = _joined(listed["docs"], np.int64), _joined(listed["known"], np.bool_)
        of = pd.DataFrame({"set_id": _joined(listed["ids"], np.int64), "n": _joined(listed["sizes"], np.int32), "hashes": None, "doc_id": pd.array(numbers, "Int64")})
        of.loc[~known, "doc_id"] = pd.NA
        counts = _joined(rows["counts"], np.int32)
        ids, sizes = np.repeat(_joined(rows["ids"], np.int64), counts), np.repeat(_joined(rows["sizes"], np.int32), counts)
        hashes, freq = _joined(rows["hashes"], np.uint64), _joined(rows["freqs"], np.int32)
        order = np.lexsort((hashes, freq, ids))
        ids, sizes, hashes = ids[order], sizes[order], hashes[order]
        bounds = (np.flatnonzero(np.append(True, ids[1:] != ids[:-1])).tolist() if len(ids) else []) + [len(ids)]
        out = [(int(ids[i]), int(sizes[i]), hashes[i:j].tobytes()) for i, j in zip(bounds, bounds[1:]) if 100 * (j - i) >= PERCENT * int(sizes[i])]
        sets = pd.DataFrame(out, columns=["set_id", "n", "hashes"]).assign(doc_id=pd.array([None] * len(out), "Int64"))
        return pd.concat([sets.astype({"set_id": np.int64, "n": np.int64}), of.astype({"n": np.int64})])

    counted = packed.groupBy("part").applyInPandas(count, f"{PACKED}, {ROWS}, freqs binary")
    return counted.groupBy("part").applyInPandas(gather, "set_id long, n long, hashes binary, doc_id long")


def anchors(sets: DataFrame) -> DataFrame:
    """Regions a set enters (anchor, set_id, n): its first shingles in the order of frequency, then hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, sizes, keys = [], [], []
            for i, n, raw in zip(batch["set_id"], batch["n"], batch["hashes"]):
                hashes = np.frombuffer(raw, np.int64)
                first = n - -(-PERCENT * n // 100) + 1 - (n - len(hashes))  # shingles found nowhere else come first
                if first > 0:
                    keys.append(hashes[:first])
                    ids.append(np.full(min(first, len(hashes)), i))
                    sizes.append(np.full(min(first, len(hashes)), n))
            if keys:
                yield pd.DataFrame({"anchor": np.concatenate(keys), "set_id": np.concatenate(ids), "n": np.concatenate(sizes)})

    return sets.select("set_id", "n", "hashes").mapInPandas(run, "anchor long, set_id long, n long")


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact Jaccard distance and whether it is near, for pairs (set_id, pivot)."""

    def compare(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, i, j in zip(x, y, n, m):
            common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            union = i + j - common
            out.append((1 - common / union, 100 * common >= PERCENT * union))
        return pd.DataFrame(out, columns=["d", "near"])

    udf = F.pandas_udf(compare, "d double, near boolean")
    left = sets.select("set_id", F.col("n").alias("n1"), F.col("hashes").alias("h1"))
    right = sets.select(F.col("set_id").alias("pivot"), F.col("n").alias("n2"), F.col("hashes").alias("h2"))
    both = pairs.join(left, "set_id").join(right, "pivot")
    return both.select("set_id", "pivot", udf("h1", "h2", "n1", "n2").alias("c")).select("set_id", "pivot", "c.d", "c.near")


# Sets and shingles a block of a cell holds, about; a shingle of more sets than SPARSE is counted by matrices.
BLOCK_SETS, BLOCK_SHINGLES, SPARSE, COLUMNS = 512, 1 << 18, 8, 4096


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many shingles every set of ``left`` shares with every one of ``right`` (places in ``sets``)."""
    k = len(sets)
    hashes, owner = np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(k), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    start = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
    column = np.cumsum(start) - 1
    freq = np.diff(np.append(np.flatnonzero(start), len(hashes)))[column]
    rare, total = (freq > 1) & (freq <= SPARSE), np.zeros(k * k, np.int64)
    h, o = hashes[rare], owner[rare]
    for step in range(1, SPARSE):
        same = np.flatnonzero(h[step:] == h[:-step])
        total += np.bincount(o[same] * k + o[same + step], minlength=k * k)
    total = total.reshape(k, k)
    out = (total + total.T)[np.ix_(left, right)]
    wide = freq > SPARSE
    owner, column = owner[wide], np.unique(column[wide], return_inverse=True)[1]
    for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        i, j = np.searchsorted(column, [first, first + COLUMNS])
        held = np.zeros((k, COLUMNS), np.float32)
        held[owner[i:j], column[i:j] - first] = 1
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that connect the sets of a pair of blocks as all their links between different roots do; equal blocks are one."""
    right = (rows["block"] == rows["b2"]).to_numpy()
    left = np.flatnonzero(~right) if not right.all() else np.arange(len(rows))
    right = np.flatnonzero(right)
    ids, roots, n = (rows[c].to_numpy() for c in ("set_id", "root", "n"))
    common = overlaps([np.frombuffer(raw, np.uint64) for raw in rows["hashes"]], left, right)
    near = (100 * common >= PERCENT * (n[left][:, None] + n[right][None, :] - common)) & (roots[left][:, None] != roots[right][None, :])
    label, before = np.arange(len(rows)), None
    while near.any() and (before is None or (label != before).any()):
        before = label.copy()
        label[left] = np.minimum(label[left], np.where(near, label[right][None, :], len(rows)).min(axis=1, initial=len(rows)))
        label[right] = np.minimum(label[right], np.where(near, label[left][:, None], len(rows)).min(axis=0, initial=len(rows)))
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame({"a": ids[moved], "b": ids[label[moved]]})


def wide(members: DataFrame, key: str, least: int) -> DataFrame:
    """``members`` of regions (anchor) with at least so many different ``key``; of regions with the very same ones one is enough."""
    mixed = [F.bit_xor(F.xxhash64(key)).alias("x"), F.bit_xor(F.xxhash64(key, F.lit(1))).alias("y")]
    alike = members.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), *mixed).where(F.col("c") >= least).groupBy("c", "x", "y")
    return members.join(alike.agg(F.min("anchor").alias("anchor")).select("anchor"), "anchor")


def blocks_of(cells: DataFrame) -> DataFrame:
    """Blocks of sets of the same cell (set_id, root, n, pivot, ring, block): a large cell is cut by distance from its pivot, then evenly."""
    many = lambda df, by: df.groupBy(by).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    ring = F.when(F.col("parts") > 1, F.coalesce(F.floor(F.col("d") / RING), F.lit(-1))).otherwise(-1).alias("ring")  # -1: any distance
    cut = cells.join(many(cells, ["pivot"]), "pivot").select("set_id", "root", "n", "pivot", ring)
    block = F.xxhash64("pivot", "ring", F.pmod(F.xxhash64("set_id"), F.col("parts"))).alias("block")
    return cut.join(many(cut, ["pivot", "ring"]), ["pivot", "ring"]).select("set_id", "root", "n", "pivot", "ring", block)


REACH = 1 - PERCENT / 100
RING = REACH / 2


def region_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets of a region within the distance of each other; ``members``: anchor, set_id, n."""
    open_ = stored(wide(members, "set_id", 2))
    # the smallest set is the pivot, so that regions that overlap have mostly the same one
    pivots = open_.groupBy("anchor").agg(F.min(F.struct(F.col("set_id").alias("pivot"), F.col("n").alias("m"))).alias("p")).select("anchor", "p.*")
    met = stored(open_.join(pivots, "anchor").select("set_id", "n", "pivot", "m").distinct())
    possible = met.where("set_id <> pivot").where(100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m"))
    known = stored(distances(possible.select("set_id", "pivot"), sets))
    links = known.where("near").select(F.col("set_id").alias("a"), F.col("pivot").alias("b"))
    # sets that the pivots connect need no more links between them: a region of one root is done
    roots = components(links).select(F.col("node").alias("set_id"), "root")
    rooted = open_.join(roots, "set_id", "left").select("anchor", "set_id", F.coalesce("root", "set_id").alias("root"))
    several = rooted.groupBy("anchor").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("anchor")
    rest = stored(rooted.join(several, "anchor", "left_semi"))
    if not rest.take(1):
        return links
    home = F.min(F.struct("pivot", F.when(F.col("set_id") == F.col("pivot"), 0.0).otherwise(F.col("d")).alias("d"))).alias("home")
    cells = met.join(known, ["set_id", "pivot"], "left").join(rest.select("set_id", "root").distinct(), "set_id").groupBy("set_id", "root", "n").agg(home)
    blocks = stored(blocks_of(cells.select("set_id", "root", "n", "home.*")))
    meet = stored(wide(rest.join(blocks, "set_id").select("anchor", "block", "pivot", "ring").distinct(), "block", 1))
    side = lambda k: meet.select("anchor", *[F.col(c).alias(f"{c[0]}{k}") for c in ("block", "pivot", "ring")])
    # by the triangle inequality sets of rings further apart than the reach are not near
    apart = (F.col("p1") == F.col("p2")) & (F.least("r1", "r2") >= 0) & ((F.abs(F.col("r1") - F.col("r2")) - 1) * RING > REACH + 1e-9)
    pairs = side(1).join(side(2), "anchor").where("b1 <= b2").where(~apart).select("b1", "b2").distinct()
    sides = pairs.select("b1", "b2", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block"))
    held = blocks.select("set_id", "root", "n", "block").join(sets.select("set_id", "hashes"), "set_id")
    more = sides.join(held, "block").groupBy("b1", "b2").applyInPandas(block_links, "a long, b long")
    return links.unionByName(more)


def grouped(docs: DataFrame, range_rows: int = 3_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) / 6 + 16)).first()[0] or 0  # about the number of shingles
    parts = 1 << max(6, int(total // range_rows).bit_length())
    both = stored(shared_shingles(dealt(docs, parts), parts))
    sigs = both.where("hashes is null").select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    sets = both.where("hashes is not null").select("set_id", "n", "hashes")
    links = stored(region_links(anchors(sets), sets))
    roots = components(links).select(F.col("node").alias("set_id"), "root")
    rooted = sigs.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    filled = rooted.where("n_shingles > 0")
    smallest = filled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = filled.join(smallest, "root").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rooted.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def kept(docs: DataFrame) -> DataFrame:
    """One document of each group: those whose doc_id is the group's smallest; repeated rows of it are one document and stay once."""
    gone, = fresh(docs, "gone")
    others = grouped(docs.select("doc_id", "text")).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, docs["doc_id"] == F.col(gone), "left_anti")
