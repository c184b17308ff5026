"""Spelling variants beside all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepanel.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def counts(docs):
    out = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    rows, forms = {}, {}
    for w, n in words.items():
        others = [v for v in words if v != w and near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            forms[w] = best
        rows[w] = (n, len(others))
    out = []
    for w, (n, k) in rows.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, n, k, forms.get(w), words.get(forms.get(w)), root))
    return sorted(out)


def changed(rng, word):
    k, c = rng.randrange(len(word) + 1), rng.choice("abéÀ÷z")
    return rng.choice([word[:k] + c + word[k:], word[:k] + word[k + 1 :], word[:k] + c + word[k + 1 :]])


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(13)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 14))) for _ in range(25)] + ["a" * 6, "a" * 7, "a" * 8, "ab" * 40, "x" * 300]
    vocabulary = {w: rng.choice([200, 30, 6]) for w in base}
    for w in base * 4:
        vocabulary.setdefault(changed(rng, w), rng.choice([5, 6, 25, 4]))
    tokens = [w if rng.random() < 0.8 else w.upper() if w.isascii() else w for w, n in vocabulary.items() for _ in range(n)]
    rng.shuffle(tokens)
    step = 40
    out = [(k, rng.choice([" ", "1", "Ā", "\n", "-", "🙂", "́"]).join(tokens[i : i + step])) for k, i in enumerate(range(0, len(tokens), step))]
    n = len(out)
    return [*out, (n, None), (n + 1, ""), (n + 2, "123 .,"), (2, out[2][1]), (2, out[2][1]), (None, out[3][1]), (n + 3, "longer" * 5000)]


@pytest.mark.parametrize("tile, rows, held", [(4096, 100_000, 300_000), (3, 50, 20)])
def test_grouped_equals_all_pairs(spark, make_docs, docs, tile, rows, held):
    expected = brute(counts(docs))
    words = spelling.word_counts(make_docs(docs), held)
    assert {r["word"]: r["n"] for r in words.collect()} == counts(docs)
    got = spelling.near(spelling.stored(words), tile, rows).collect()
    assert Counter((r["word"], r["near"]) for r in got) == Counter((a, b) for a in counts(docs) for b in counts(docs) if a != b and near(a, b))
    out = spelling.grouped(make_docs(docs)).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, out.collect())) == expected
    assert sum(r[3] is not None for r in expected) > 10


def test_chains_and_ties(spark, make_docs):
    text = " ".join(["aaaaaa"] * 5 + ["aaaaab"] * 30 + ["aaaabb"] * 200 + ["bbbbbb"] * 5 + ["bbbbbd"] * 25 + ["bbbbbc"] * 25 + ["alone"] * 50)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.grouped(make_docs([(7, text)])).collect()}
    assert got["aaaaaa"] == (5, 1, "aaaaab", 30, "aaaabb") and got["aaaaab"][4] == "aaaabb"
    assert got["bbbbbb"] == (5, 2, "bbbbbc", 25, "bbbbbc") and "alone" not in got
    assert got["bbbbbc"] == (25, 2, None, None, "bbbbbc")


def test_empty_table_and_extra_columns(spark, make_docs):
    assert spelling.grouped(make_docs([])).count() == 0
    rows = make_docs([(1, "wordone " * 6)]).withColumn("word", F.lit("x")).withColumn("tile", F.lit(1))
    assert [(r["word"], r["n"], r["n_near"], r["form"], r["root"]) for r in spelling.grouped(rows).collect()] == [("wordone", 6, 0, None, "wordone")]
