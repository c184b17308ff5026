"""Byte-level BPE: code-point classes and a scan of transition functions find the pieces, cached pair merging the ids.

The automaton's states say what kind of token is open. Its transition functions compose
associatively, so blocks of code points are composed side by side, the short list of
blocks is scanned, and the states are filled in; no regular expression is involved.

Cases: a null or empty text has no tokens; a text of any length is one run of the scan;
repeated rows and other columns are untouched; decoding the ids gives the text's bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points of white space, and letters after an apostrophe that end a contraction.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

L, N, O, SP, WS, A1, A2, RESET = range(8)  # symbols: letter, number, other, blank, other white space, apostrophe before 1 or 2 letters, end of text
FRESH, IN_L, IN_N, IN_O, IN_SP, IN_WS, LEFT1, LEFT2 = range(8)  # states
BLOCK = 64


def _transitions() -> np.ndarray:
    t = np.empty((8, 8), np.uint8)
    for symbol, state in ((L, IN_L), (N, IN_N), (O, IN_O), (SP, IN_SP), (WS, IN_WS), (A1, LEFT1), (A2, LEFT2), (RESET, FRESH)):
        t[symbol] = state
    t[L, LEFT2], t[L, LEFT1] = LEFT1, FRESH
    for symbol in (A1, A2):  # a mark that continues other marks, or takes a blank before it, opens no contraction
        t[symbol, [IN_O, IN_SP]] = IN_O
    return t


def _starts() -> np.ndarray:
    """Whether a token starts at a symbol, by the state before it; white space after white space is decided apart."""
    s = np.ones((8, 8), bool)
    s[L, [IN_L, IN_SP, LEFT1, LEFT2]] = False
    s[N, [IN_N, IN_SP]] = False
    for symbol in (O, A1, A2):
        s[symbol, [IN_O, IN_SP]] = False
    for symbol in (SP, WS):
        s[symbol, [IN_SP, IN_WS]] = False
    return s


TRANSITIONS, STARTS = _transitions(), _starts()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    kinds = {"L": L, "N": N}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], O) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = WS
    table[32] = SP
    return np.append(table, np.uint8(RESET))  # 0x110000 separates texts


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before every symbol, from FRESH."""
    n = len(symbols)
    if n <= BLOCK:
        out, s = np.empty(n, np.uint8), FRESH
        for i, x in enumerate(symbols.tolist()):
            out[i] = s
            s = TRANSITIONS[x, s]
        return out
    pad = -n % BLOCK
    grid = np.append(symbols, np.full(pad, RESET, np.uint8)).reshape(-1, BLOCK)
    functions = np.tile(np.arange(8, dtype=np.uint8), (len(grid), 1))
    for j in range(BLOCK):
        functions = TRANSITIONS[grid[:, j][:, None], functions]
    state = compose_scan(functions)
    out = np.empty(grid.shape, np.uint8)
    for j in range(BLOCK):
        out[:, j] = state
        state = TRANSITIONS[grid[:, j], state]
    return out.reshape(-1)[:n]


def compose_scan(functions: np.ndarray) -> np.ndarray:
    """State before every block, from FRESH: blocks of functions are composed side by side until few are left."""
    n = len(functions)
    if n <= BLOCK:
        out, s = np.empty(n, np.uint8), FRESH
        for i in range(n):
            out[i] = s
            s = functions[i, s]
        return out
    pad = -n % BLOCK
    grid = np.concatenate([functions, np.tile(np.arange(8, dtype=np.uint8), (pad, 1))]).reshape(-1, BLOCK, 8)
    rows = np.arange(len(grid))[:, None]
    joined = np.tile(np.arange(8, dtype=np.uint8), (len(grid), 1))
    for j in range(BLOCK):
        joined = grid[:, j][rows, joined]
    state = compose_scan(joined)
    out = np.empty(grid.shape[:2], np.uint8)
    for j in range(BLOCK):
        out[:, j] = state
        state = grid[:, j][rows[:, 0], state]
    return out.reshape(-1)[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point; texts are followed by 0x110000."""
    kind = classes()[points]
    symbols = kind.copy()
    mark = np.flatnonzero(points == ord("'"))
    if len(mark):
        ahead = np.append(points, [0x110000, 0x110000])
        first, second = ahead[mark + 1], ahead[mark + 2]
        symbols[mark[np.isin(first, [ord(c) for c in ONE_LETTER])]] = A1
        for a, b in TWO_LETTERS:
            symbols[mark[(first == ord(a)) & (second == ord(b))]] = A2
    state = states_before(symbols)
    start = STARTS[symbols, state]
    white = (kind == SP) | (kind == WS)
    follows = np.append(kind[1:], RESET)
    inside = white & ((state == IN_SP) | (state == IN_WS))
    start |= inside & (follows != SP) & (follows != WS) & (follows != RESET)  # the last white space before a word stands apart
    return start


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """Rank of a pair of tokens whose bytes together are a token, for many pairs at once."""

    NONE = 1 << 40

    def __init__(self, ranks: dict[bytes, int], bits: int = 21):
        keys, found = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 20 | right)
                    found.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.found = np.array(keys, np.int64)[order], np.array(found, np.int64)[order]
        self.bits = np.uint64(64 - bits)
        slot = self._slot(self.keys)
        self.table = np.full(1 << bits, -1, np.int64)
        self.table[slot[::-1]] = np.arange(len(slot))[::-1]  # the first key of each slot
        self.shared = np.bincount(slot, minlength=1 << bits) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.bits).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 20 | right
        if not len(self.keys):
            return np.full(len(keys), self.NONE)
        slot = self._slot(keys)
        at = self.table[slot]
        hit = (at >= 0) & (self.keys[at] == keys)
        other = np.flatnonzero(~hit & self.shared[slot])
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            hit[other] = self.keys[at[other]] == keys[other]
        return np.where(hit, self.found[at], self.NONE)


class Coder:
    """Encoder and decoder over a table of ranks; pieces seen before come from a bounded cache."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 200_000):
        self.ranks, self.cache_size = ranks, cache_size
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = {rank: str(rank) for rank in self.tokens}
        self.single = np.array([ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        self.pairs = PairTable(ranks)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.sizes[list(self.tokens)] = list(map(len, self.tokens.values()))
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of every piece: join the neighbouring pair of lowest rank, the leftmost first, until none is left.

        All pieces go through the rounds side by side; a round joins one pair of each.
        """
        out: list = [self.ranks.get(p) for p in pieces]
        out = [None if x is None else (x,) for x in out]
        todo = [i for i, x in enumerate(out) if x is None and len(pieces[i]) <= 64]
        for i, x in enumerate(out):
            if x is None and len(pieces[i]) > 64:
                out[i] = self._merge_long(pieces[i])
        if not todo:
            return out
        size = np.array([len(pieces[i]) for i in todo], np.int64)
        token = self.single[np.frombuffer(b"".join([pieces[i] for i in todo]), np.uint8)]
        which = np.array(todo, np.int64)
        none = PairTable.NONE
        pair = np.append(self.pairs.rank(token[:-1], token[1:]), none)
        pair[np.cumsum(size) - 1] = none
        while True:
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(pair, first)
            done = best == none
            if done.any():
                ids, bounds = token.tolist(), zip(first[done].tolist(), (first + size)[done].tolist(), which[done].tolist())
                for i, j, k in bounds:
                    out[k] = tuple(ids[i:j])
                keep = np.repeat(~done, size)
                token, pair = token[keep], pair[keep]
                size, which, best = size[~done], which[~done], best[~done]
                if not len(size):
                    return out
            owner = np.repeat(np.arange(len(size)), size)
            hits = np.flatnonzero(pair == best[owner])
            at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
            token[at] = best
            keep = np.ones(len(token), bool)
            keep[at + 1] = False
            token, pair = token[keep], pair[keep]
            at = at - np.arange(len(at))  # one removal in each piece before
            size = size - 1
            last = np.cumsum(size) - 1
            nxt = np.where(at == last, at, at + 1)
            pair[at] = np.where(at == last, none, self.pairs.rank(token[at], token[nxt]))
            inner = at[at > last - size + 1]
            pair[inner - 1] = self.pairs.rank(token[inner - 1], token[inner])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        n, ranks = len(piece), self.ranks
        end, ahead, back = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = ahead[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        while heap:
            _, i, j, e = heapq.heappop(heap)
            if not alive[i] or ahead[i] != j or j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], ahead[i] = e, ahead[j]
            if ahead[i] < n:
                back[ahead[i]] = i
            offer(i)
            if back[i] >= 0:
                offer(back[i])
        return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        parts = []
        for t in texts:
            parts += [np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0x110000], np.uint32)]
        points = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        width = (points < 0x110000).astype(np.uint8)
        for least in (0x80, 0x800, 0x10000):
            width += (points >= least) & (points < 0x110000)
        offset = np.zeros(len(points) + 1, np.int64)  # byte offsets of all texts in a row
        np.cumsum(width, out=offset[1:])
        start = boundaries(points)
        is_end = points == 0x110000
        cuts = offset[:-1][start]
        stops = np.searchsorted(np.flatnonzero(start), np.flatnonzero(is_end)).tolist()
        raw = "".join(texts).encode()
        cuts_list, out, begin = cuts.tolist(), [], 0
        for stop in stops:  # the separator itself counts as a start, and closes the last piece
            edge = cuts_list[begin : stop + 1]
            out.append([raw[i:j] for i, j in zip(edge, edge[1:])])
            begin = stop + 1
        return out

    def encode(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For every text the ids of its pieces, piece by piece."""
        cache, split = self.cache, self.pieces(texts)
        flat = list(chain.from_iterable(split))
        got = list(map(cache.get, flat))
        if None in got:
            missing = list({p for p, ids in zip(flat, got) if ids is None})
            new = dict(zip(missing, self.merge(missing)))
            got = [new[p] if ids is None else ids for p, ids in zip(flat, got)]
            if len(cache) + len(new) > self.cache_size:
                cache.clear()
            cache.update((p, ids) for p, ids in new.items() if len(p) <= 64)
        out, at = [], 0
        for pieces in split:
            out.append(got[at : at + len(pieces)])
            at += len(pieces)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of every token."""
        size = self.sizes[ids]
        return (np.cumsum(size) - size).astype(np.int32)


def _groups(texts: Iterable[str | None], limit: int = 200_000) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters, so that a scan's arrays stay small."""
    group: list[str] = []
    size = 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


_CODERS: dict[str, Coder] = {}


def coder_of(shared: Broadcast) -> Coder:
    """One coder per worker process and table, so that tasks of the same worker share its cache."""
    name, ranks = shared.value
    if name not in _CODERS:
        _CODERS.clear()
        _CODERS[name] = Coder(ranks)
    return _CODERS[name]


def share(df: DataFrame, ranks: dict[bytes, int]) -> Broadcast:
    """The table of ranks for the tasks; a vocabulary bounds its size."""
    name = hashlib.sha256(b"".join(sorted(ranks)) + repr(sorted(ranks.values())).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((name, ranks))


def encoded(df: DataFrame, text: str, ranks: dict[bytes, int], into: str = "tokens", with_offsets: bool = True) -> DataFrame:
    """``df`` with a struct column: ids and, if wanted, the byte offset of every token. The table of ranks travels to the tasks.

    A task holds one Arrow batch and the tokens of one run of texts at a time; runs leave as batches of their own.
    A column named ``into`` is replaced.
    """
    shared = share(df, ranks)
    if into == text:
        raise ValueError("the tokens need a column of their own")
    rest = df.drop(into)
    place = rest.columns.index(text)
    plain = rest.toDF(*[f"c{i}" for i in range(len(rest.columns))])  # names may hold dots
    fields = [T.StructField(name, T.ArrayType(T.IntegerType())) for name in ["ids", *["offsets"] * with_offsets]]
    kinds = pa.struct([pa.field(f.name, pa.list_(pa.int32())) for f in fields])

    def listed(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            at = 0
            for group in _groups(x.as_py() for x in batch.column(place)):
                ids = [np.fromiter(chain.from_iterable(got), np.int32) for got in coder.encode(group)]
                columns = [listed(ids)] + [listed([coder.offsets(x) for x in ids])] * with_offsets
                part = batch.slice(at, len(group))
                at += len(group)
                tokens = pa.StructArray.from_arrays(columns, fields=list(kinds))
                yield pa.RecordBatch.from_arrays([*part.columns, tokens], names=[*part.schema.names, "tokens"])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("tokens", T.StructType(fields))]))
    return out.toDF(*rest.columns, into)


def decoded(df: DataFrame, ids: str, ranks: dict[bytes, int], into: str = "bytes") -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids give null."""
    shared = share(df, ranks)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = coder_of(shared)
        for batch in batches:
            yield pd.Series([None if x is None else coder.decode(list(x)) for x in batch], dtype=object)

    return df.withColumn(into, run(F.col(ids)))


def digests(df: DataFrame, text: str, ranks: dict[bytes, int], into: str = "digest") -> DataFrame:
    """``df`` with a struct: n_tokens, and digests of the ids and of the bytes decoded from them."""
    shared = share(df, ranks)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = coder_of(shared)
        for batch in batches:
            rows = []
            for group in _groups(batch.tolist()):
                for got in coder.encode(group):
                    ids = list(chain.from_iterable(got))
                    listed = ",".join(map(coder.names.__getitem__, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.withColumn(into, run(F.col(text)))
