"""Alignment of two tokenizers beside the tokenizer libraries and plain loops."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def files():
    return alignment.Vocabularies(Path(A).read_bytes(), Path(B).read_bytes(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    back = {c: b for b, c in byte_letters().items()}
    a_bytes = {i: bytes(back[c] for c in piece) for piece, i in a.get_vocab(with_added_tokens=False).items()}
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    b_bytes = {}
    for i in range(len(b)):
        p = b.id_to_piece(i)
        b_bytes[i] = bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    return a, a_bytes, b, b_bytes


def byte_letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def brute(texts, libraries):
    """Per text: n_a, n_b, groups as lists, links as id pairs."""
    a, a_bytes, b, b_bytes = libraries
    out = []
    for text in texts:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes[i] for i in ia) != raw or b"".join(b_bytes[i] for i in ib) != raw:
            out.append((0, 0, [], []))
            continue
        ends = [], []
        for ids, table, e in ((ia, a_bytes, ends[0]), (ib, b_bytes, ends[1])):
            at = 0
            for i in ids:
                at += len(table[i])
                e.append(at)
        groups, links, x, y = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append((ia[x:p], ib[y:q]))
            links.append((ia[p - 1], ib[q - 1]))
            x, y = p, q
        out.append((len(ia), len(ib), groups, links))
    return out


def brute_report(docs, libraries):
    found = brute([t for _, t in docs], libraries)
    counts = Counter(p for *_, links in found for p in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    rows = []
    for (i, _), (n_a, n_b, groups, links) in zip(docs, found):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        rows.append((i, n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(rows, key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(12)
    pieces = ["the", " ", "  ", "\n", "Straße", "naïve", "don't", "1234", "<s>", "<|endoftext|>", "日本語", " ", "é", "🙂", "\t", "...", "<0x41>", "﻿", "xyzzyq", "\0", "\r\n"]
    out = [(k, "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60)))) for k in range(80)]
    out += [(80, None), (81, ""), (82, " "), (83, "   "), (84, "a ▁ b"), (85, "▁"), (86, "x" * 3000), (87, "word " * 4000), (3, out[3][1]), (None, out[4][1]), (1 << 60, "end")]
    return out


@pytest.mark.parametrize("run_links", [4_000_000, 60])
def test_reported_equals_libraries(spark, make_docs, files, libraries, docs, run_links, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 500)
    if run_links == 60:  # several levels of merging, several slices
        monkeypatch.setattr(alignment, "FAN", 3)
        monkeypatch.setattr(alignment, "TOGETHER", 2)
        monkeypatch.setattr(alignment, "FRAME", 7)
    got = alignment.reported(make_docs(docs).repartition(3), files, run_links)
    if run_links > 60:
        assert sorted(map(tuple, alignment.reported(make_docs(docs).coalesce(1), files).collect()), key=repr) == brute_report(docs, libraries)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_report(docs, libraries)


def test_pairs_and_groups(spark, make_docs, files, libraries, docs):
    shared = spark.sparkContext.broadcast(files)
    spilled = alignment.stored(alignment.runs(make_docs(docs).repartition(2), shared, 100))
    found = brute([t for _, t in docs], libraries)
    counts = Counter(p for *_, links in found for p in links)
    got = alignment.pairs(spilled, shared).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == counts and len(got) == len(counts)
    most = {b: max(n for (_, other), n in counts.items() if other == b) for _, b in counts}
    assert all(r["best"] == (r["n"] == most[r["b"]]) for r in got)
    rows = {r["doc_id"]: r["groups"] for r in alignment.groups(make_docs(docs[:40]), files).collect()}
    for (i, text), (_, _, groups, _) in zip(docs[:40], found):
        assert [(g["a"], g["b"]) for g in rows[i]] == groups
        raw = (" " + text).encode()
        assert b"".join(raw[g["start"] : g["end"]] for g in rows[i]) == (raw if groups else b"")


def test_empty_table_and_extra_columns(spark, make_docs, files):
    assert alignment.reported(make_docs([]), files).count() == 0
    row = alignment.reported(make_docs([(1, None)]).withColumn("run", F.lit(1)), files).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_merge_keeps_every_pair():
    rng = np.random.default_rng(0)
    runs, total = [], Counter()
    for _ in range(9):
        keys = np.unique(rng.integers(0, 500, 200))
        n = rng.integers(1, 1 << 40, len(keys))
        total.update(dict(zip(keys.tolist(), n.tolist())))
        runs.append(alignment.framed(keys, n))
    keys, n = alignment.all_heads(alignment.merged(runs))
    assert dict(zip(keys.tolist(), n.tolist())) == total and (np.diff(keys) > 0).all()
    assert alignment.largest(np.array([1, 1, 4, 7, 7]), np.array([3, 5, 2, 1, 1])).tolist() == [5, 5, 2, 1, 1]
