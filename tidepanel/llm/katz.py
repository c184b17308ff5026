"""LM scoring by Katz backoff: Good-Turing discounted bigram counts, backing off to single words.

Words are counted over all training texts. The ``vocabulary`` most frequent ones are cached:
they have numbers, and their counts and backoff weights are broadcast. This only saves space:
all other words go by their hashes and have bigrams, counts and backoff weights of their own in
the partitioned tables, so the size of the cache does not change the result.
Bigrams are packed by parts into binary columns: distinct ones per task travel, a part adds
them up, and the parts form the stored model. The counts of uncached second words come by a join,
as sums per first word. For scoring, the bigrams of the texts meet the part that holds them; an
unseen bigram's uncached second word then meets the word counts. Very frequent first words are
spread over all parts.

P(w | h) = d(c) c / C(h) for seen pairs, with d the Good-Turing discount up to counts of 5, and
alpha(h) P(w) for others; alpha(h) is the mass the discounts free, over the mass of the words
not seen after h, and so normalises exactly. A context whose counts are all above 5 frees half
a count.

Cases: a null or empty text is one end token; repeated rows are scored alike; a null doc_id is
the text "null" for the split; texts are used whole; without training texts the words are
uniform; other columns are not touched; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

FOLDS, HELD = 7, 2
TOP, HOT = 5, 512  # counts that are discounted; first words spread over all parts


def signed(word: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


STOP = b" end"  # no word holds a blank


class Names(dict):
    """Hash of a word, remembered for as many words as ``size``."""

    def __init__(self, size: int = 400_000):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.size:
            self.clear()
        value = self[word] = signed(word)
        return value


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # on bytes: only A-Z, only ASCII white space


class Places(dict):
    """Words in the order in which they first occur."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def chunks(batches: Iterator[pd.DataFrame], flush: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """About ``flush`` tokens at a time: the texts' rids and sizes, the hashes of the distinct words (the end first), every token's place among these."""
    names = Names()
    places, rids, sizes, found = Places({STOP: 0}), [], [], []
    cut = lambda: (np.array(rids, np.int64), np.array(sizes, np.int64), np.fromiter(map(names.__getitem__, places), np.int64, len(places)), np.array(found, np.int64))
    for batch in batches:
        for rid, t in zip(batch["rid"], batch["text"]):
            words = split_words(t)
            rids.append(rid)
            sizes.append(len(words) + 1)
            found.extend(map(places.__getitem__, words))
            found.append(0)
            if len(found) >= flush:
                yield cut()
                places, rids, sizes, found = Places({STOP: 0}), [], [], []
    if rids:
        yield cut()


@dataclass
class Words:
    """The cached words: position in ``hashes`` is the number, most frequent first."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self) -> None:
        self.k = len(self.hashes)
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]
        rest = self.total - int(self.counts.sum()) + self.distinct - self.k
        self.p = (np.append(self.counts, rest) + 1.0) / (self.total + self.distinct + 1)  # the last one is all other words together

    def number_of(self, names: np.ndarray) -> np.ndarray:
        """Numbers of words that are called by number, if cached, or by hash; k for the latter."""
        return np.where((names >= 0) & (names < self.k + 2), names, self.k)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers; k for a word that is not cached."""
        if not self.k:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.k - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], self.k)


def marked(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % FOLDS
    return docs.select("doc_id", "text", (fold == HELD).alias("held_out"), F.xxhash64("doc_id", "text").alias("rid"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash) and its count over the training texts; a task adds up before rows travel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = Counter()
        added = lambda: pd.DataFrame({"word": list(map(signed, counts)), "n": list(counts.values())})
        for batch in batches:
            for t in batch["text"]:
                counts.update(split_words(t))
            counts[STOP] += len(batch)
            if len(counts) > 1_000_000:
                yield added()
                counts.clear()
        if counts:
            yield added()

    return docs.where("not held_out").select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numpy(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _deltas(a: np.ndarray) -> bytes:
    return _squeeze(np.diff(a, prepend=0))


def _ints(raw: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _sums(raw: bytes) -> np.ndarray:
    return np.cumsum(_ints(raw))


def part_of(first: np.ndarray, second: np.ndarray, parts: int) -> np.ndarray:
    mix = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.where((first >= 0) & (first < HOT), second, 0).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mix ^ (mix >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64) % parts


PACKED = "part long, keys binary, docs binary, times binary, rids binary, first binary, second binary, hashed_docs binary, hashed_times binary, hashed_rids binary"


def packed_pairs(docs: DataFrame, words, parts: int, by_doc: bool, flush: int = 900_000) -> DataFrame:
    """Bigrams of the texts by part: with counts per task, or, for scoring, per document.

    Bigrams of cached words are keyed by both numbers; the others by two names, a number or a hash.
    """

    def split(part: np.ndarray, values: list[np.ndarray], doc: np.ndarray, times: np.ndarray, rids: np.ndarray, side: str) -> pd.DataFrame:
        order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # two bytes are sorted by digits
        part, doc, times, values = part[order], doc[order], times[order], [v[order] for v in values]
        bounds = (np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(part) else []) + [len(part)]
        rows = []
        for i, j in zip(bounds, bounds[1:]):
            named = [_deltas(values[0][i:j])] + [_squeeze(v[i:j]) for v in values[1:]]
            owners = (b"", b"")
            if by_doc:
                here = np.zeros(len(rids), bool)
                here[doc[i:j]] = True
                owners = (_squeeze((np.cumsum(here) - 1)[doc[i:j]].astype(np.int32)), rids[here].tobytes())
            rows.append((int(part[i]), *named, owners[0], _squeeze(times[i:j].astype(np.int32)), owners[1]))
        names = ["first", "second"] if side else ["keys"]
        return pd.DataFrame(rows, columns=["part", *names, f"{side}docs", f"{side}times", f"{side}rids"])

    def pack(rids: np.ndarray, sizes: np.ndarray, own: np.ndarray, second: np.ndarray) -> pd.DataFrame:
        w = words.value
        numbers = np.append(w.number(own), w.k + 1)
        first = np.roll(second, 1)
        first[np.cumsum(sizes) - sizes] = len(own)  # before the first word
        doc = np.repeat(np.arange(len(rids)), sizes) if by_doc else np.zeros(len(second), np.int64)
        hashed = (numbers[first] == w.k) | (numbers[second] == w.k)

        many = len(rids) if by_doc else 1
        both = (numbers[first] * (w.k + 2) + numbers[second])[~hashed] * many + doc[~hashed]
        both, times = np.unique(both, return_counts=True)
        key, own_doc = both // many, both % many
        rows = split(part_of(key // (w.k + 2), key % (w.k + 2), parts), [key], own_doc, times, rids, "")

        one, two, doc = first[hashed], second[hashed], doc[hashed]
        called = np.where(numbers == w.k, np.append(own, 0), numbers)
        one, two = called[one], called[two]
        order = np.lexsort((doc, two, one))
        one, two, doc = one[order], two[order], doc[order]
        new = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (doc[1:] != doc[:-1]))) if len(one) else np.empty(0, np.int64)
        times = np.diff(np.append(new, len(one)))
        one, two, doc = one[new], two[new], doc[new]
        others = split(part_of(one, two, parts), [one, two], doc, times, rids, "hashed_")
        out = rows.merge(others, "outer", "part") if len(others) else rows.reindex(columns=[*rows.columns, *others.columns[1:]])
        return out.astype(object).where(out.notna(), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks(batches, flush):
            yield pack(*chunk)

    return docs.select("rid", "text").mapInPandas(run, PACKED)


def _joined(column: pd.Series, read=_ints, *kind) -> np.ndarray:
    """The values of all rows that have any, one after the other."""
    return np.concatenate([np.empty(0, *kind or (np.int64,)), *[read(x, *kind) for x in column if x is not None]])


SPECTRUM = [f"n{r}" for r in range(1, TOP + 2)]
TABLE = "part long, keys binary, counts binary, first binary, second binary, hashed_counts binary, " + ", ".join(f"{n} long" for n in SPECTRUM)


def bigram_table(pairs: DataFrame) -> DataFrame:
    """The stored counts: one row per part with its sorted bigrams, their counts, and how many have count 1..TOP + 1."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        keys, which = np.unique(_joined(rows["keys"], _sums), return_inverse=True)
        counts = np.bincount(which, _joined(rows["times"], _ints, np.int32), len(keys)).astype(np.int64)
        first, second, times = _joined(rows["first"], _sums), _joined(rows["second"]), _joined(rows["hashed_times"], _ints, np.int32)
        order = np.lexsort((second, first))
        first, second, times = first[order], second[order], times[order]
        new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))) if len(first) else np.empty(0, np.int64)
        hashed = np.add.reduceat(times.astype(np.int64), new) if len(new) else np.empty(0, np.int64)
        spectrum = np.bincount(np.minimum(np.append(counts, hashed), TOP + 2), minlength=TOP + 3)[1 : TOP + 2].tolist()
        row = (int(rows["part"].iloc[0]), _deltas(keys), _squeeze(counts), _deltas(first[new]), _squeeze(second[new]), _squeeze(hashed), *spectrum)
        return pd.DataFrame([row], columns=["part", "keys", "counts", "first", "second", "hashed_counts", *SPECTRUM])

    return pairs.groupBy("part").applyInPandas(add, TABLE)


def uncached_mass(table: DataFrame, counts: DataFrame, words, parts: int) -> DataFrame:
    """first (number or hash), its part, and the mass of the uncached words seen after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = words.value
        for batch in batches:
            for one, two in zip(batch["first"], batch["second"]):
                one, two = _sums(one), _ints(two)
                rare = w.number_of(two) == w.k
                yield pd.DataFrame({"first": one[rare], "word": two[rare]})

    asked = table.select("first", "second").mapInPandas(run, "first long, word long").join(counts, "word")
    w = words.value
    summed = asked.groupBy("first").agg(F.sum((F.col("n") + 1) / float(w.total + w.distinct + 1)).alias("mass"))

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = batch["first"].to_numpy()
            yield batch.assign(part=part_of(first, np.zeros(len(first), np.int64), parts))

    return summed.mapInPandas(parted, "first long, mass double, part long")


def contexts(table: DataFrame, mass: DataFrame, words, factors: np.ndarray) -> DataFrame:
    """Per cached first word: sum of counts, what the discounts free of it, the mass of the words seen after it, and what uncached words keep of the counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = words.value
        for batch in batches:
            for raw, times, one, two, hashed in zip(batch["keys"], batch["counts"], batch["first"], batch["second"], batch["hashed_counts"]):
                keys, counts, one, two, hashed = _sums(raw), _ints(times), _sums(one), _ints(two), _ints(hashed)
                cached = w.number_of(one) != w.k
                second = np.append(keys % (w.k + 2), np.full(int(cached.sum()), w.k))
                first, counts = np.append(keys // (w.k + 2), one[cached]), np.append(counts, hashed[cached])
                first, which = np.unique(first, return_inverse=True)
                kept = factors[np.minimum(counts, TOP + 1)] * counts
                add = lambda x: np.bincount(which, x, len(first))  # noqa: E731, B023
                p = np.append(w.p[:-1], 0.0)[second]
                yield pd.DataFrame({"first": first, "total": add(counts).astype(np.int64), "freed": add(counts - kept), "mass": add(p), "outside": add(kept * (second == w.k))})

    rows = table.select("keys", "counts", "first", "second", "hashed_counts").mapInPandas(run, "first long, total long, freed double, mass double, outside double")
    k = words.value.k
    more = mass.where(F.col("first").between(0, k + 1)).select("first", F.lit(0).cast("long"), F.lit(0.0), "mass", F.lit(0.0))
    return rows.union(more).groupBy("first").agg(*[F.sum(c).alias(c) for c in ["total", "freed", "mass", "outside"]])


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing factors for counts 1..TOP, by Katz; half a count where the counts of counts give none in (0, 1)."""
    d = np.array([(r - 0.5) / r for r in range(1, TOP + 1)])
    if all(n):
        cut = (TOP + 1) * n[TOP] / n[0]
        for r in range(1, TOP + 1):
            got = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if cut < 1 else 0.0
            d[r - 1] = got if 0 < got < 1 else d[r - 1]
    return d


def backoff(total: np.ndarray, freed: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha and the scale of the seen bigrams, by first word."""
    none = freed < 1e-9
    left = np.where(none, 0.5 / (total + 0.5), freed / np.maximum(total, 1))
    return left / np.maximum(1 - mass, 1e-12), np.where(none, total / (total + 0.5), 1.0)


@dataclass
class Model:
    """What is broadcast: the cached words with the contexts they are."""

    words: Words
    factors: np.ndarray  # by count, 1 above TOP
    total: np.ndarray  # by first word
    alpha: np.ndarray
    scale: np.ndarray
    outside: np.ndarray  # probability of all uncached words together

    def log_p(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each bigram's second word (as a number) after the first; number k stands for all uncached words together."""
        w = self.words
        first, second = keys // (w.k + 2), keys % (w.k + 2)
        seen = self.factors[np.minimum(counts, TOP + 1)] * counts / np.maximum(self.total[first], 1) * self.scale[first]
        unseen = np.where(second == w.k, self.outside[first], self.alpha[first] * w.p[second])
        return np.log10(np.where(counts > 0, seen, unseen))


def fit_contexts(words: Words, factors: np.ndarray, rows: list[np.ndarray], uncached: list[np.ndarray]) -> Model:
    """``rows`` of ``contexts``, and the part of their mass that is of uncached words."""
    first, total, freed, mass, kept = rows
    totals, alpha, scale, outside = np.zeros(words.k + 2, np.int64), np.ones(words.k + 2), np.ones(words.k + 2), np.full(words.k + 2, words.p[-1])
    seen = np.zeros(words.k + 2)
    seen[uncached[0]] = uncached[1]
    alpha[first], scale[first] = backoff(total, freed, mass)
    totals[first] = total
    outside[first] = kept / np.maximum(total, 1) * scale[first] + alpha[first] * (words.p[-1] - seen[first])
    return Model(words, factors, totals, alpha, scale, outside)


def fit(docs: DataFrame, vocabulary: int = 1 << 18, part_tokens: int = 2_000_000):
    """Word counts (stored), the cached words, the stored bigram table, the model and the number of parts."""
    counts, shared, table, model, parts, _ = fitted(docs, vocabulary, part_tokens)
    return counts, shared, table, model, parts


def fitted(docs: DataFrame, vocabulary: int, part_tokens: int = 2_000_000):
    """As ``fit``, and the stored masses of uncached words by first word."""
    spark = docs.sparkSession
    counts = stored(word_counts(docs))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(vocabulary)
    words = Words(*_numpy(top.select("word", "n")), int(total), int(distinct))
    shared = spark.sparkContext.broadcast(words)
    parts = max(32, int(total // part_tokens))
    table = stored(bigram_table(packed_pairs(docs.where("not held_out"), shared, parts, by_doc=False)))
    spectrum = table.agg(*[F.coalesce(F.sum(n), F.lit(0)) for n in SPECTRUM]).first()
    factors = np.concatenate([[0.0], discounts(list(spectrum)), [1.0]])
    mass = stored(uncached_mass(table, counts, shared, parts))
    cached = _numpy(mass.where(F.col("first").between(0, words.k + 1)).select("first", "mass"))
    model = fit_contexts(words, factors, _numpy(contexts(table, mass, shared, factors)), cached)
    return counts, shared, table, model, parts, mass


def ranked(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``values`` in the sorted, distinct ``among``, and which are there."""
    if not len(among):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return at, among[at] == values


class Hashed:
    """The bigrams of a part that have an uncached word, and the contexts of its uncached first words."""

    def __init__(self, model: Model, first: np.ndarray, second: np.ndarray, counts: np.ndarray, mass_of: np.ndarray, mass: np.ndarray):
        self.m, w = model, model.words
        self.counts, self.firsts, self.seconds = counts, np.unique(first), np.unique(second)
        which = np.searchsorted(self.firsts, first)
        self.keys = which * len(self.seconds) + np.searchsorted(self.seconds, second)
        add = lambda x: np.bincount(which, x, len(self.firsts)).astype(float)
        self.total = add(counts)
        at, there = ranked(mass_of, self.firsts)
        seen = add(np.append(w.p[:-1], 0.0)[w.number_of(second)])
        seen[at[there]] += mass[there]
        self.alpha, self.scale = backoff(self.total, add(counts * (1 - model.factors[np.minimum(counts, TOP + 1)])), seen)

    def log_p(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each probability, for unseen bigrams with an uncached second word without that word's own; and which these are."""
        m, w = self.m, self.m.words
        a, known = ranked(first, self.firsts)
        b, there = ranked(second, self.seconds)
        at, seen = ranked(a * len(self.seconds) + b, self.keys)
        seen &= known & there
        n = np.where(seen, self.counts[at], 0) if len(self.counts) else np.zeros(len(first), np.int64)
        number, other = w.number_of(first), w.number_of(second)
        cached = number != w.k
        own = lambda x, one: np.where(cached, one[number], np.where(known, x[a], 0 if one is m.total else 1)) if len(x) else one[number]
        total, alpha, scale = own(self.total, m.total), own(self.alpha, m.alpha), own(self.scale, m.scale)
        late = (n == 0) & (other == w.k)
        p = np.where(n > 0, m.factors[np.minimum(n, TOP + 1)] * n / np.maximum(total, 1) * scale, alpha * np.where(other == w.k, 1.0, w.p[other]))
        return np.log10(p), late


def scored(docs: DataFrame, vocabulary: int = 1 << 18) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text); ``vocabulary`` is the size of the cache."""
    texts = marked(docs)
    counts, shared, table, model, parts, mass = fitted(texts, vocabulary)
    spark = docs.sparkSession
    learned, words = spark.sparkContext.broadcast(model), model.words
    base = float(words.total + words.distinct + 1)

    def pair_sums(pairs: pd.DataFrame, model_rows: pd.DataFrame) -> pd.DataFrame:
        m = learned.value
        known, seen = _joined(model_rows["keys"], _sums), _joined(model_rows["counts"])
        masses = model_rows[model_rows["mass"].notna()]
        first, second, hashed_counts = _joined(model_rows["first"], _sums), _joined(model_rows["second"]), _joined(model_rows["hashed_counts"])
        hashed = Hashed(m, first, second, hashed_counts, _joined(masses["mass_of"]), _joined(masses["mass"], _ints, np.float64))
        sums, late = [], []
        for keys, local, times, rids in zip(pairs["keys"], pairs["docs"], pairs["times"], pairs["rids"]):
            if keys is None:
                continue
            keys, local, times, rids = _sums(keys), _ints(local, np.int32), _ints(times, np.int32), np.frombuffer(rids, np.int64)
            count = np.zeros(len(keys), np.int64)
            if len(known):
                at, there = ranked(keys, known)
                count = np.where(there, seen[at], 0)
            sums.append(pd.DataFrame({"rid": rids, "s": np.bincount(local, times * m.log_p(keys, count), len(rids))}))
        for one, two, local, times, rids in zip(*[pairs[c] for c in ("first", "second", "hashed_docs", "hashed_times", "hashed_rids")]):
            if one is None:
                continue
            one, two, local, times, rids = _sums(one), _ints(two), _ints(local, np.int32), _ints(times, np.int32), np.frombuffer(rids, np.int64)
            logs, left = hashed.log_p(one, two)
            sums.append(pd.DataFrame({"rid": rids, "s": np.bincount(local, times * logs, len(rids))}))
            late.append(pd.DataFrame({"rid": rids[local[left]], "word": two[left], "times": times[left].astype(np.int64)}))
        out = pd.concat(sums).groupby("rid", as_index=False).sum() if sums else pd.DataFrame({"rid": np.empty(0, np.int64), "s": np.empty(0)})
        rows = pd.concat([out.assign(word=pd.array([None] * len(out), "Int64"), times=0), *[x.assign(s=0.0, word=x["word"].astype("Int64")) for x in late]])
        return rows[["rid", "s", "word", "times"]]

    def pack_mass(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows["part"].iloc[0], _squeeze(rows["first"].to_numpy()), _squeeze(rows["mass"].to_numpy()))], columns=["part", "mass_of", "mass"])

    masses = mass.where(~F.col("first").between(0, words.k + 1)).groupBy("part").applyInPandas(pack_mass, "part long, mass_of binary, mass binary")
    pairs = packed_pairs(texts, shared, parts, by_doc=True)
    rows = table.drop(*SPECTRUM).unionByName(masses, allowMissingColumns=True)
    sums = pairs.groupBy("part").cogroup(rows.groupBy("part")).applyInPandas(pair_sums, "rid long, s double, word long, times long")
    sums = stored(sums.groupBy("rid", "word").agg(F.sum("s").alias("s"), F.sum("times").alias("times")))
    pair_score = sums.where("word is null").select("rid", F.col("s").alias("pair_score"))
    late = sums.where("word is not null").select("rid", "word", F.lit(0).cast("long").alias("times"), F.col("times").alias("unseen"))

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row of figures of every text, and one for each of its words that is not cached."""
        w = shared.value
        logs = np.append(np.log10((w.counts + 1) / base), 0.0)
        for rids, sizes, own, found in chunks(batches, 500_000):
            doc, number = np.repeat(np.arange(len(rids)), sizes), w.number(own)[found]
            cached = number < w.k
            whole = pd.DataFrame({"rid": rids, "n_tokens": sizes, "known": np.bincount(doc[cached], minlength=len(rids)), "base": np.bincount(doc, logs[number], len(rids))})
            pairs, times = np.unique(doc[~cached] * len(own) + found[~cached], return_counts=True)
            rare = pd.DataFrame({"rid": rids[pairs // len(own)], "n_tokens": 0, "known": 0, "base": 0.0, "word": own[pairs % len(own)], "times": times, "copies": 0})
            # a text's own row meets no word: its name only spreads these rows, and it counts none
            yield pd.concat([whole.assign(word=rids, times=0, copies=1), rare])

    zero = F.lit(0).cast("long")
    own = texts.select("rid", "text").mapInPandas(own_words, "rid long, n_tokens long, known long, base double, word long, times long, copies long").withColumn("unseen", zero)
    late = late.withColumns({"n_tokens": zero, "known": zero, "base": F.lit(0.0), "copies": zero})
    n = F.coalesce("n", F.lit(0))
    log_p = F.log10((n + 1) / base)
    word_sums = own.unionByName(late).join(counts, "word", "left").groupBy("rid").agg(
        F.sum("copies").alias("copies"), F.sum("n_tokens").alias("n_tokens"),  # equal rows add to the same sums
        F.sum(F.col("known") + F.when(n > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("base") + F.col("times") * log_p).alias("base"), F.sum(F.col("unseen") * log_p).alias("rare_score"),
    )
    out = texts.select(F.col("doc_id").cast("long"), "held_out", "rid").join(word_sums, "rid").join(pair_score, "rid", "left")
    share = lambda c: F.coalesce(c, F.lit(0)) / F.col("copies")
    return out.select(
        "doc_id", "held_out", share("n_tokens").cast("long").alias("n_tokens"), share("known").cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        share("base").alias("base_score"), (share("pair_score") + share("rare_score")).alias("score"),
    )
