"""Suffix dedup: bytes covered by a 200-byte string that occurs twice anywhere are removed.

A string of 200 bytes holds the smallest hash of its 32-byte strings; equal strings hold it
at the same place. Only suffixes at such anchors are sorted. Anchors first meet by hashes: one
that occurs once is no repeat, and one whose surroundings are the same at every place repeats
as far as its text goes. Of the others every different surrounding is fetched once, keyed by
the anchor and the 84 bytes on one side of it, of which any 200 bytes around an anchor hold
one side whole. Within a key the text after and, reversed, before the anchors is
put in suffix order by deep-shallow sorting: a multikey sort on the first words, then blind
tries for the groups still tied. The common prefixes of neighbours give, for every offset
of a 200-byte string around the anchor, the classes of equal left and right parts.

Cases: a null or empty text, or one below 200 bytes, loses nothing; repeated rows are texts
of their own that repeat each other; texts are used whole, matches never cross them; other
columns are not touched; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM  # bytes around the anchor that a string can take on one side
HALF = REACH // 2
SHALLOW = 2  # words of eight bytes sorted before the tries take over
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every GRAM bytes, by differences of a running sum with powers of an odd base, modulo 2^64."""
    n = len(data)
    down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, INVERSE, np.uint64)))
    up = np.cumprod(np.append(np.uint64(1), np.full(n - GRAM, BASE, np.uint64)))
    x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    total = np.append(np.uint64(0), np.cumsum(x * down))
    h = (total[GRAM:] - total[:-GRAM]) * up
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    step, out = 1, values
    while 2 * step <= width:
        out = take(out[:-step], out[step:])
        step *= 2
    return out if step == width else take(out[: len(values) - width + 1], out[width - step :])


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the strings that are smallest in some window of LENGTH bytes."""
    if len(raw) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(np.frombuffer(raw, np.uint8))
    width = REACH + 1
    low = _sliding(h, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), width, np.maximum) == h)
    return at, h[at].astype(np.int64)


def blind_trie_order(rows: list[bytes], width: int) -> tuple[list[int], list[int]]:
    """Order of rows of equal width, and the common prefix of each with the one before it.

    Inner nodes keep only the place where their rows first differ; a search follows the
    bytes at those places, and one comparison with the leaf it ends in finds the true place.
    """
    numbers = [int.from_bytes(r, "big") for r in rows]
    root: list = [width, {}, [0]]  # place, children, members of a leaf
    for i in range(1, len(rows)):
        row, node = rows[i], root
        while node[1]:
            node = node[1].get(row[node[0]]) or next(iter(node[1].values()))
        differ = numbers[i] ^ numbers[node[2][0]]
        if not differ:
            node[2].append(i)
            continue
        place, other = width - (differ.bit_length() + 7) // 8, rows[node[2][0]]
        node = root
        while node[0] < place:
            node = node[1][row[node[0]]]
        if node[0] == place:
            node[1][row[place]] = [width, {}, [i]]
        else:
            node[:] = [place, {other[place]: list(node), row[place]: [width, {}, [i]]}, node[2]]
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple[list, int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if not node[1]:
            order += node[2]
            common += [shared] + [width] * (len(node[2]) - 1)
        else:
            keys = sorted(node[1], reverse=True)
            stack += [(node[1][k], shared if k == keys[-1] else node[0]) for k in keys]
    return order, common


def deep_shallow_order(rows: list[bytes], groups: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` by (group, bytes) and the common prefix with the row before it in the group (-1 at its first)."""
    n, words = len(rows), -(-width // 8)
    matrix = np.frombuffer(b"".join(r.ljust(words * 8, b"\0") for r in rows), ">u8").reshape(n, words)
    order = np.lexsort([matrix[:, j] for j in reversed(range(SHALLOW))] + [groups])
    head = np.column_stack([groups[order].astype(np.int64).view(np.uint64), matrix[order, :SHALLOW].astype(np.uint64)])
    new = np.append(True, (head[1:] != head[:-1]).any(axis=1)) if n else np.empty(0, bool)
    common = np.zeros(n, np.int64)
    starts = np.flatnonzero(new).tolist() + [n]
    for i, j in zip(starts, starts[1:]):
        if j - i > 1:
            own = order[i:j]
            inner, shared = blind_trie_order([rows[k] for k in own.tolist()], width)
            order[i:j] = own[inner]
            common[i:j] = shared
        if i == 0 or groups[order[i]] != groups[order[i - 1]]:
            common[i] = -1
        else:
            differ = int.from_bytes(rows[order[i]], "big") ^ int.from_bytes(rows[order[i - 1]], "big")
            common[i] = width - (differ.bit_length() + 7) // 8
    return order, common


def marked_offsets(keys: np.ndarray, left: list[bytes], right: list[bytes], times: np.ndarray, low: int, high: int) -> np.ndarray:
    """For every row and every l in low..high: does the string of l bytes before and REACH - l after the anchor occur twice?

    ``left`` (reversed) and ``right`` may be cut short by the text's ends; ``times`` counts equal rows.
    """
    n, widths = len(keys), (high, REACH - low)
    sides = []
    for texts, width in zip((left, right), widths):
        order, common = deep_shallow_order([t.ljust(width, b"\0") for t in texts], keys, max(width, 8 * SHALLOW))
        sides.append((order, common, np.fromiter(map(len, texts), np.int64, n)))
    out = np.zeros((n, high - low + 1), bool)
    for l in range(low, high + 1):
        classes = []
        for (order, common, _), depth in zip(sides, (l, REACH - l)):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(common < depth)
            classes.append(c)
        fits = np.flatnonzero((sides[0][2] >= l) & (sides[1][2] >= REACH - l))
        if len(fits):
            _, which = np.unique(classes[0][fits] * (n + 1) + classes[1][fits], return_inverse=True)
            out[fits, l - low] = np.bincount(which, times[fits])[which] > 1
    return out


def _map(df: DataFrame, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


PLACE = {"rid": np.int64, "pos": np.int32, "ctx": np.int64, "same": np.bool_}


def packed(places: DataFrame) -> DataFrame:
    """``places`` (rid, pos, ctx, same) as binary columns, a row per batch."""
    one = lambda batch: pd.DataFrame({c: [batch[c].to_numpy(t).tobytes()] for c, t in PLACE.items()})
    return _map(places, one, ", ".join(f"{c} binary" for c in PLACE))


def unpacked(rows: DataFrame) -> DataFrame:
    all_ = lambda batch: pd.DataFrame({c: np.frombuffer(b"".join(batch[c]), t) for c, t in PLACE.items()})
    return _map(rows, all_, "rid long, pos int, ctx long, same boolean")


def repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw")).withColumn("rid", F.xxhash64("doc_id", "raw"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, total // 4_000_000)

    def find(batch: pd.DataFrame) -> pd.DataFrame:
        rids, pos, anchor, ctx = [], [], [], []
        for rid, raw in zip(batch["rid"], batch["raw"]):
            raw = bytes(raw)
            at, hashes = anchors(raw)
            rids.append(np.full(len(at), rid, np.int64))
            pos.append(at)
            anchor.append(hashes)
            ctx += [xxhash.xxh3_64_intdigest(raw[max(p - REACH, 0) : p + LENGTH], seed=min(p, REACH)) for p in at.tolist()]
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return pd.DataFrame({"rid": join(rids), "pos": join(pos).astype(np.int32), "anchor": join(anchor), "ctx": np.array(ctx, np.uint64).view(np.int64)})

    at = _map(texts.where(F.octet_length("raw") >= LENGTH).select("rid", "raw"), find, "rid long, pos int, anchor long, ctx long")
    met = Window.partitionBy("anchor")
    repeated = at.select("rid", "pos", "ctx", F.count(F.lit(1)).over(met).alias("n"), F.min("ctx").over(met).alias("low"), F.max("ctx").over(met).alias("high")).where("n > 1")
    # an anchor whose surroundings are equal everywhere is decided by its count alone; stored, so that the anchors are found and dealt out once
    places = unpacked(stored(packed(repeated.select("rid", "pos", "ctx", (F.col("low") == F.col("high")).alias("same")))))
    unlike = places.where("not same").groupBy("ctx").agg(F.min(F.struct("rid", "pos")).alias("at"), F.count(F.lit(1)).alias("times"))
    samples = unlike.select("at.rid", "at.pos", "ctx", "times").groupBy("rid").agg(F.collect_set(F.struct("pos", "ctx", "times")).alias("found"))

    def surround(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for raw, spots in zip(batch["raw"], batch["found"]):
            raw = bytes(raw)
            for spot in spots:
                pos, ctx, times = spot["pos"], spot["ctx"], spot["times"]
                end = pos + GRAM
                if pos >= HALF:
                    out.append((xxhash.xxh3_64_intdigest(raw[pos - HALF : end]), ctx, times, 0, raw[max(pos - REACH, 0) : pos][::-1], raw[end : end + REACH - HALF]))
                if end + HALF + 1 <= len(raw):
                    out.append((xxhash.xxh3_64_intdigest(raw[pos : end + HALF + 1], seed=1), ctx, times, 1, raw[max(pos - HALF + 1, 0) : pos][::-1], raw[end : end + REACH]))
        frame = pd.DataFrame(out, columns=["key", "ctx", "times", "side", "before", "after"])
        return frame.assign(key=frame["key"].to_numpy(np.uint64).view(np.int64))

    # every surrounding is fetched once; the same columns as in the last join, so that the texts are dealt out once
    around = _map(texts.join(samples, "rid").select("doc_id", "rid", "raw", "found"), surround, "key long, ctx long, times long, side int, before binary, after binary")

    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for side, own in rows.groupby("side"):
            low, high = (HALF, REACH) if side == 0 else (0, HALF - 1)
            seen: dict[tuple, int] = {}  # equal surroundings within the reach of this side are one
            which = np.array([seen.setdefault(x, len(seen)) for x in zip(own["key"], own["before"], own["after"])], np.int64)
            times = np.bincount(which, own["times"].to_numpy()).astype(np.int64)
            keys = np.fromiter((k for k, _, _ in seen), np.int64, len(seen))
            marks = marked_offsets(keys, [b for _, b, _ in seen], [a for _, _, a in seen], times, low, high)
            wide = np.zeros((len(seen), REACH + 1), np.uint8)
            wide[:, low : high + 1] = marks
            bits = [w.tobytes() for w in np.packbits(wide, axis=1)]
            hit = marks.any(axis=1)[which]
            out.append(pd.DataFrame({"ctx": own["ctx"].to_numpy()[hit], "marks": [bits[i] for i in which[hit].tolist()]}))
        return pd.concat(out) if out else pd.DataFrame({"ctx": [], "marks": []})

    marks = around.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInPandas(mark, "ctx long, marks binary")
    marks = marks.groupBy("ctx").agg(F.collect_set("marks").alias("marks"))  # one of each side
    whole = places.where("same").select("rid", "pos", F.lit(None).cast("array<binary>").alias("marks"))
    partly = places.where("not same").join(marks, "ctx").select("rid", "pos", "marks")
    found = whole.unionByName(partly).groupBy("rid").agg(F.collect_set(F.struct("pos", "marks")).alias("found"))

    def cut(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, raw, spots in zip(batch["doc_id"], batch["raw"], batch["found"]):
            raw = bytes(raw)
            edge = np.zeros(len(raw) + 1, np.int64)
            for spot in spots if spots is not None else []:
                pos = spot["pos"]
                if spot["marks"] is None:  # whatever fits into the text
                    edge[pos - min(pos, REACH)] += 1
                    edge[pos - max(0, REACH + pos + GRAM - len(raw)) + LENGTH] -= 1
                    continue
                for bits in spot["marks"]:
                    l = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: REACH + 1])
                    np.add.at(edge, pos - l, 1)
                    np.add.at(edge, pos - l + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int((gone & ~np.append(False, gone[:-1])).sum())
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((doc, len(raw), int(gone.sum()), spans, kept))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        return frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    every = texts.join(found, "rid", "left").select(F.col("doc_id").cast("long"), "raw", "found")
    return _map(every, cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def reported(docs: DataFrame) -> DataFrame:
    return repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
