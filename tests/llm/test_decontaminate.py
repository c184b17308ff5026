"""The positional index beside a brute-force search: phrases, proximity and the cases of the docstring."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidepanel.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def all_windows(items, width):
    out = defaultdict(set)
    for item, text in items:
        w = words(text)
        for a in range(max(len(w) - width, 0) + 1 if w else 0):
            out[tuple(w[a : a + width])].add((item, a))
    return out


def brute_report(text, found):
    w, hit, items = words(text), set(), set()
    for window, where in found.items():
        for a in range(len(w) - len(window) + 1):
            if tuple(w[a : a + len(window)]) == window:
                hit |= set(range(a, a + len(window)))
                items |= {str(i) for i, _ in where if i is not None}
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def brute_near(text, window, slack):
    """Shortest stretches [first, last] with all different words of the window, from every pair of ends."""
    w, need = words(text), set(window)
    good = {(s, e) for s in range(len(w)) for e in range(s, min(len(w), s + len(window) + slack)) if need <= set(w[s : e + 1])}
    return {(s, e) for s, e in good if not {(s + 1, e), (s, e - 1)} & good}


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "ЖУК", "中文", "the", "the", "the"]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(str(k), " ".join(prose(n))) for k, n in enumerate([30, 12, 10, 9, 3, 1, 25])]
    items += [("7", "the the the the the the the the the the the the"), ("8", None), ("9", ""), (None, " ".join(prose(14))), ("1", items[1][1]), ("10", items[2][1])]
    docs = []
    for k in range(60):
        w = prose(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            source = (rng.choice([t for _, t in items if t])).split()
            a = rng.randrange(len(source))
            piece = source[a : a + rng.randint(5, 30)]
            if rng.random() < 0.3:
                rng.shuffle(piece)
            at = rng.randint(0, len(w))
            w[at:at] = piece
        docs.append((k, rng.choice([" ", "-", ". \n", "\0"]).join(w)))
    docs += [(60, None), (61, ""), (62, " .,! "), (63, items[0][1].upper()), (5, docs[5][1]), (5, items[0][1]), (None, items[1][1]), (64, " ".join(prose(20_000) + items[0][1].split())), (65, "the " * 40)]
    return docs, items


@pytest.mark.parametrize("segment_words", [1_000_000, 150])
def test_phrases_and_proximity(spark, make_docs, cases, segment_words):
    docs, items = cases
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id string, text string, segment int")
    index = decontaminate.stored(decontaminate.index(make_docs(docs), segment_words))
    order = {(r["segment"], k): i for r in index.where("part is null").collect() for k, i in enumerate(r["doc_ids"])}
    found = decontaminate.matches(index, table, 10, 3).collect()
    spans = defaultdict(list)
    for r in found:
        spans[order[r["segment"], r["doc"]], r["kind"]].append(r)
    wanted = all_windows(items, 10)
    for i, text in docs:
        if list(d for d, _ in docs).count(i) > 1:
            continue
        got = {(r["item_id"], r["item_at"] + k, r["doc_at"] + k) for r in spans[i, "phrase"] for k in range(max(r["words"] - 9, 1))}
        w = words(text)
        expected = {(item, a, p) for window, where in wanted.items() for p in range(len(w) - len(window) + 1) if tuple(w[p : p + len(window)]) == window for item, a in where}
        assert got == expected
        if len(w) < 1000:
            got = {(r["item_id"], r["item_at"], r["doc_at"], r["doc_at"] + r["words"] - 1) for r in spans[i, "near"]}
            assert got == {(item, a, s, e) for window, where in wanted.items() for s, e in brute_near(text, window, 3) for item, a in where}


def test_reported_equals_brute_force(spark, make_docs, cases, monkeypatch):
    docs, items = cases
    table = spark.createDataFrame(items, "item_id string, text string")
    expected = sorted([(i, *brute_report(t, all_windows(items, 10))) for i, t in docs], key=repr)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = decontaminate.reported(make_docs(docs), table)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == expected
    near = {r["doc_id"]: r["n_near"] for r in got.collect()}
    assert near[63] >= 1 and near[60] == 0
    # the way without a broadcast and with several slices gives the same
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 0)
    monkeypatch.setattr(decontaminate, "SLICE_WINDOWS", 20)
    assert sorted(map(tuple, decontaminate.reported(make_docs(docs), table).select(columns).collect()), key=repr) == expected


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([("1", "one two three")], "item_id string, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert decontaminate.reported(make_docs([]), items).count() == 0
    row = decontaminate.reported(make_docs([(1, "one two three four")]), none).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"], r["items_sha256"]) for r in row] == [(4, 0, False, hashlib.sha256(b"").hexdigest())]
    row = decontaminate.reported(make_docs([(1, "zero One two THREE four")]), items).collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in row] == [(3, 1, True)]


def test_chunks_cover_every_window():
    got = list(decontaminate.chunks(np.array([3, 0, 9, 1, 1, 20, 0]), most=5))
    assert [i for s in got for i in range(s.start, s.stop)] == list(range(7))
