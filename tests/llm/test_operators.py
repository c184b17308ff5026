"""Every operator beside a brute-force version on small tables, and its cases: nulls, ties, copies, long texts, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import byte_bpe, common, katz, licenses, line_dedup, mixing, personal_data, quality_rules, shingle_join, suffix_dedup, topk_search

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def sample_texts():
    """Unlike texts, exact and near copies, a null, an empty, a blank, a short and a long one, and a repeated row."""
    rng = random.Random(5)
    rows = [(i, "\n".join(prose(rng, rng.randint(8, 40)) for _ in range(3))) for i in range(30)]
    near = rows[3][1].split(" ")
    near[4] = "changed"
    rows += [(30, rows[2][1]), (31, rows[2][1]), (32, " ".join(near)), (33, None), (34, ""), (35, " \n\t"), (36, "one two"), (37, "One TWO")]
    rows += [(38, prose(rng, 9000)), (39, "aaaa " * 300), (2, rows[2][1]), (None, rows[5][1])]
    return rows


def union_find(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 5), (5, 5), (5, 7), (300, 7), (None, 3)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 141)}, 5: 5, 7: 5, 300: 5}


def test_edit_distance(spark):
    rng, rows = random.Random(3), []
    for _ in range(400):
        a = [rng.choice("abé ") for _ in range(rng.randint(20, 60))]
        b = a[:]
        for _ in range(rng.randint(0, 4)):
            i, kind = rng.randrange(len(b)), rng.random()
            b[i : i + (kind < 0.6)] = [] if 0.3 < kind < 0.6 else [rng.choice("abx")]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for tau in (1, 2, 3):
        got = df.where(line_dedup.close(F.col("a"), F.col("b"), tau) != (F.levenshtein("a", "b") <= tau)).count()
        assert got == 0


def test_line_dedup(make_docs):
    base = "the quick brown fox jumps over the lazy dog"
    rows = [(1, f"{base}\nfirst only line of one"), (2, f"{base}\nshort\n{base[:-1]}t\nsecond only line of two"), (3, base.replace("quick", "qick")), (4, None), (5, ""), (None, base), (6, f"{base} far away")]
    docs = make_docs(rows)
    got = {r.doc_id: tuple(r)[1:] for r in line_dedup.reported(docs).collect() if r.doc_id is not None}
    assert got == {1: (2, 0, 0, ""), 2: (4, 2, 1, "0,2"), 3: (1, 1, 1, "0"), 4: (0, 0, 0, ""), 5: (1, 0, 0, ""), 6: (1, 0, 0, "")}
    left = {(r.doc_id, r.text) for r in line_dedup.cleaned(docs).collect()}
    assert left == {(1, rows[0][1]), (2, "short\nsecond only line of two"), (4, None), (5, ""), (None, base), (6, rows[6][1])}
    assert line_dedup.cleaned(docs).columns == docs.columns
    assert line_dedup.reported(make_docs([])).count() == 0


def test_rule_statistics():
    for text in [t for _, t in sample_texts()] + ["a b c d e f a b c d e f", "x # y\nx # y\n\n"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        at = defaultdict(list)
        for i in range(len(words) - 4):
            at[tuple(words[i : i + 5])].append(i)
        covered = {i + j for places in at.values() if len(places) > 1 for i in places for j in range(5)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expected = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert quality_rules.measure(text)[:5] == expected


def test_quality_rules(spark, make_docs):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(30, 90))) for i in range(120)]
    rows += [(i, " ".join(w.upper() + "$$$" for w in prose(rng, 50).split())) for i in range(120, 160)] + [(160, None), (161, "too short"), (3, rows[3][1])]
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 160, 2)] + [(None, 1, 0), (161, None, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    got = {r.doc_id: r.kept for r in quality_rules.judged(docs, labels).collect()}
    assert not any(got[i] for i in range(120, 162)) and sum(got[i] for i in range(120)) >= 117
    kept = quality_rules.filtered(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality_rules.judged(make_docs([]), labels).count() == 0
    assert quality_rules.judged(docs, labels.limit(0)).where("kept").count() == 161


def test_quality_rules_keep_one_python_worker_a_task(spark, make_docs, capsys):
    rng = random.Random(8)
    docs = make_docs([(i, prose(rng, 40) if i < 30 else "$ # buy " * 3) for i in range(40)] + [(None, None), (41, ""), (41, prose(rng, 30))])
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(40)], "doc_id long, quality int")
    kept = quality_rules.filtered(docs, labels)
    kept.explain()
    plan = capsys.readouterr().out
    assert len(re.findall("ArrowEvalPython|BatchEvalPython|InPandas|InArrow", plan)) == 1
    judged = quality_rules.judged(docs, labels).where("kept")
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in judged.collect())


def test_shingle_join(make_docs):
    rows = sample_texts()[:-1]
    rng = random.Random(9)
    body = prose(rng, 200).split(" ")
    for i in range(100, 140):  # a chain and a star of near copies
        copy = body[:]
        copy[(i * 7) % 200] = f"v{i}"
        rows.append((i, " ".join(copy)))
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(links, sets)
    docs = make_docs(rows)
    got = shingle_join.grouped(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((d, len(sets[d]), root[d]) for d, _ in rows)
    kept = shingle_join.kept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(root.values())
    assert shingle_join.grouped(make_docs([]).select("doc_id", "text")).count() == 0


def test_shingles_travel_once_and_short(make_docs):
    """One pass deals out the sets, seven bytes a shingle, and tells every row's set, also of null ids and empty texts."""
    rows = sample_texts()
    parts = 64
    packed = shingle_join.dealt(make_docs(rows).select("doc_id", "text").coalesce(1), parts)
    texts = {t.lower() for _, t in rows if t}
    words = shingle_join.WordHash()
    sizes = {t: len(shingle_join.shingle_set(t, words)) for t in texts}
    sent = packed.where("docs is null").agg(F.sum(F.octet_length("hashes"))).first()[0]
    assert sent == 7 * sum(n for t, n in sizes.items() if n)
    got = shingle_join.shared_shingles(packed, parts).where("hashes is null").collect()
    expected = sorted((str(d), sizes[t.lower()] if t else 0) for d, t in rows)
    assert sorted((str(r.doc_id), r.n) for r in got) == expected and len({r.set_id for r in got}) == len({t.lower() for t in texts if sizes[t]}) + 1


def test_regions_of_the_same_members_are_one(spark):
    """Twelve near copies share many anchors; their regions are compared once, and the links are those of all."""
    sets = spark.createDataFrame([(i, 100, np.append(np.arange(99), 1000 + i).astype(np.uint64).tobytes()) for i in range(12)], "set_id long, n long, hashes binary")
    members = spark.createDataFrame([(a, i, 100) for a in range(21) for i in range(12)], "anchor long, set_id long, n long")
    seen = []
    plain = shingle_join.stored
    try:
        shingle_join.stored = lambda df: seen.append((df.columns, (out := plain(df)).count())) or out
        links = shingle_join.region_links(members, sets).collect()
    finally:
        shingle_join.stored = plain
    assert next(n for columns, n in seen if "anchor" in columns) == 12
    assert set(union_find([(r.a, r.b) for r in links], range(12)).values()) == {0}


def test_far_members_of_a_region_are_not_paired_as_rows(spark, monkeypatch):
    """Sets at 0.1 to 0.4 of each other in two regions: all links' components, and no table of members by members."""
    rng = np.random.default_rng(4)
    base, sets = np.arange(100), {}
    for i in range(300):
        own = np.concatenate([rng.permutation(base)[: rng.integers(82, 97)], rng.integers(100, 400, 9)])
        sets[i] = np.unique(own).astype(np.uint64)
    near = lambda a, b: 100 * (c := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - c)
    members = [(0, i) for i in range(300)] + [(1, i) for i in range(100, 300)]
    links = [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])]
    sizes, seen, plain = {i: len(s) for i, s in sets.items()}, [], shingle_join.stored
    rows = spark.createDataFrame([(i, sizes[i], s.tobytes()) for i, s in sets.items()], "set_id long, n long, hashes binary")
    monkeypatch.setattr(shingle_join, "stored", lambda df: seen.append((out := plain(df)).count()) or out)
    monkeypatch.setattr(shingle_join, "BLOCK_SETS", 40, raising=False)  # cells are cut into rings and blocks
    got = shingle_join.region_links(spark.createDataFrame([(a, i, sizes[i]) for a, i in members], "anchor long, set_id long, n long"), rows).collect()
    expected = union_find(links, sets)
    assert len(set(expected.values())) > 3 and union_find([(r.a, r.b) for r in got], sets) == expected
    assert max(seen) <= len(members)


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(shingle_join, "COLUMNS", 7)
    sets = [np.unique(rng.integers(0, 60, n)).astype(np.uint64) for n in rng.integers(0, 40, 25)] + [np.unique(rng.integers(0, 1000, 200)).astype(np.uint64) for _ in range(6)]
    left, right = np.arange(0, 31, 2), np.arange(1, 31, 2)
    for i, j in ((left, right), (np.arange(31), np.arange(31))):
        off = i[:, None] != j[None, :]  # a set is not compared with itself
        expected = np.array([[len(np.intersect1d(sets[a], sets[b])) for b in j] for a in i])
        assert (shingle_join.overlaps(sets, i, j) == expected)[off].all()
    assert shingle_join.overlaps([], np.arange(0), np.arange(0)).shape == (0, 0)


def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(230, 8)))]
    vectors += [(i, vectors[7][1]) for i in range(230, 260)] + [(300, None), (350, [1.0, None] + [0.0] * 6), (400, [float("nan")] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, label int")
    q = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in vectors[:260]}
    expected = set()
    for i in (x for x in q if x % 50 == 0):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:5]
        expected |= {(i, k, j, -s) for k, (s, j) in enumerate(best, 1)}
    assert {tuple(r) for r in topk_search.search(df).collect()} == expected
    assert {tuple(r) for r in topk_search.search(df, vectors_each=60, queries_each=2).collect()} == expected
    assert topk_search.search(df.limit(0)).count() == 0
    assert topk_search.search(df.where("vec_id in (0, 3)")).count() == 1


def test_personal_data(make_docs):
    text = "mail a.b@c.example.com or x@y, ip 10.0.0.255 and 10.0.0.256, call +1 (743) 555-3824, card 4111 1111 1111 1111 é"
    token = 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6" end'
    rows = [(1, text), (2, None), (3, ""), (4, token), (5, "9" * 30000), (6, "a@b.co_x@d.ee")] + [(i, token.replace("1eb9", f"{i:04d}")) for i in range(10, 40)]
    got = {r.doc_id: r for r in personal_data.found(make_docs(rows).select("doc_id", "text")).collect()}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def sound(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    for d, t in rows:
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, t or "") if sound(k, m.group()))
        listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert got[d].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in patterns] == [sum(s[3] == k for s in spans) for k in patterns]
    assert "secret:9:49" in got[4].spans and got[2].spans == ""
    assert personal_data.found(make_docs([]).select("doc_id", "text")).count() == 0


def test_personal_data_in_long_runs(make_docs):
    """Long runs cost time in proportion to their length, long keys are candidates, many matches keep their places."""
    rng = random.Random(14)
    key = "".join(rng.choice("abcdef0123456789") for _ in range(240))
    mails = " ".join(f"u{i}@x{i}.org" for i in range(3000))
    rows = [(1, "x" * 80_000 + " a@b.co"), (2, "1" * 80_000 + " 1.2.3.4"), (3, f'token = "{key}"'), (4, mails), (5, "a@b.c_d@e.f x@y@z.de 1.2.3.4.5.6.7.8")]
    rows += [(10 + i, f"token = \"sk-{rng.randrange(10**30):030d}\" and plain_words_joined_by_underscores") for i in range(40)]
    begun = time.monotonic()
    got = {r.doc_id: r for r in personal_data.found(make_docs(rows).select("doc_id", "text")).collect()}
    assert time.monotonic() - begun < 40
    assert (got[1].n_email, got[2].n_ip, got[4].n_email, got[5].n_email, got[5].n_ip) == (1, 1, 3000, 3, 2)
    assert got[1].spans == "email:80001:80007" and got[2].spans == "ip:80001:80008"
    assert got[4].spans == ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"\S+", mails))
    assert got[3].spans == "secret:9:249" and all("secret:9:42" in got[10 + i].spans for i in range(40))


def test_labelers_outvote_the_strict_form():
    """The first vote is the strict form's; the others agree with each other and win both ways."""
    real, noise = ["2", "1", "0", "quote", "quote", "assigned"], ["2", "0", "0", "space", "space", "plain"]
    row = lambda votes, shape, n: {"kind": "secret", "votes": votes, "shape": shape, "n": n}
    rows = [row([1, 1, 1, 1, 1], real, 400), row([-1, 1, 1, 1, 1], real, 100), row([-1, 0, -1, -1, 0], noise, 800), row([1, 0, -1, -1, 0], noise, 100)]
    bias, weights = personal_data.train(rows)["secret"]
    odds = lambda shape: bias + sum(w[x] for w, x in zip(weights, shape))
    assert odds(real) > 0 > odds(noise)


def test_gazetteer(spark):
    rows = [("phone", "(212) 555 0101", 1), ("phone", "(999) 555 0101", 0), ("secret", "ghp_" + "a" * 30, 1), ("secret", "a" * 30, 0), ("ssn", "078-05-1120", -1), ("ssn", "536-22-8726", 0)]
    for kind, found, vote in rows:
        assert spark.range(1).select(personal_data.known(kind, F.lit(found))).first()[0] == vote


def test_katz(make_docs):
    rows = sample_texts()
    got = katz.scored(make_docs(rows).select("doc_id", "text")).collect()
    held = lambda d: zlib.crc32(str("null" if d is None else d).encode()) % 7 == 2
    split = lambda t: (t or "").encode().lower().split() + [None]
    c = Counter(w for d, t in rows if not held(d) for w in split(t))
    total, distinct = sum(c.values()), len(c)
    assert len(got) == len(rows)
    by = {d: t for d, t in rows}
    for r in got:
        words = split(by[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(c[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words))
        assert r.score < 0
    assert katz.scored(make_docs([]).select("doc_id", "text")).count() == 0


def test_katz_normalises(spark, make_docs):
    docs = katz.marked(make_docs(sample_texts()).select("doc_id", "text"))
    counts, shared, table, model, _ = katz.fit(docs, vocabulary=100)
    seen = {}
    for row in table.collect():
        seen |= dict(zip(katz._sums(row["keys"]).tolist(), katz._ints(row["counts"]).tolist()))
    k = model.words.k
    for first in [0, 1, 7, 99, k, k + 1]:
        keys = np.array([first * (k + 2) + s for s in range(k + 1)])
        mass = 10 ** model.log_p(keys, np.array([seen.get(int(x), 0) for x in keys]))
        assert mass.sum() == pytest.approx(1.0)


def katz_scores(rows, held):
    """log10 scores by brute force, every training word with counts of its own."""
    split = lambda t: (t or "").encode().lower().split() + [None]
    train = [split(t) for d, t in rows if not held(d)]
    words = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["start", *t], t))
    size = sum(words.values()) + len(words) + 1
    of = Counter(pairs.values())
    d = katz.discounts([of[r] for r in range(1, katz.TOP + 2)])
    kept = lambda c: c * d[c - 1] if c <= katz.TOP else c
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def p(h, w):
        seen, total = after.get(h, {}), sum(after.get(h, {}).values())
        if not seen:
            return (words[w] + 1) / size
        freed = total - sum(map(kept, seen.values()))
        share = total / (total + 0.5) if freed < 1e-9 else 1.0
        if w in seen:
            return kept(seen[w]) / total * share
        left = 0.5 / (total + 0.5) if freed < 1e-9 else freed / total
        return left * (words[w] + 1) / size / (1 - sum((words[x] + 1) / size for x in seen))

    return {d: sum(math.log10(p(h, w)) for h, w in zip(["start", *split(t)], split(t))) for d, t in rows}


def test_katz_keeps_every_word(make_docs):
    """The score is that of the whole model, however few words are cached."""
    rng = random.Random(12)
    rows = sample_texts() + [(i, " ".join(f"x{int(rng.paretovariate(0.6))}" for _ in range(60))) for i in range(200, 260)]
    held = lambda d: zlib.crc32(str("null" if d is None else d).encode()) % 7 == 2
    expected = katz_scores(rows, held)
    assert sum(held(d) for d, _ in rows) > 5
    docs = make_docs(rows).select("doc_id", "text")
    for vocabulary in (1, 20, 100, 1 << 18):
        got = katz.scored(docs, vocabulary=vocabulary).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.score == pytest.approx(expected[r.doc_id]), (vocabulary, r.doc_id)


def test_katz_splits_the_texts_once_for_all_word_figures(make_docs, capsys):
    """Sizes, known and base scores and uncached words come from one pass over the texts."""
    katz.scored(make_docs(sample_texts()).select("doc_id", "text")).explain("simple")
    assert capsys.readouterr().out.count("MapInPandas") == 1


def test_suffix_dedup(make_docs):
    rng = random.Random(4)
    passage = prose(rng, 70)
    rows = sample_texts() + [(50, f"{prose(rng, 30)} {passage} {prose(rng, 20)}"), (51, f"{passage}é{prose(rng, 40)} {passage[:230]}"), (52, passage[:199])]
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(raw[i : i + 200] for _, raw in raws for i in range(len(raw) - 199))
    expected = []
    for d, raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum())
        expected.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.reported(make_docs(rows)).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert suffix_dedup.reported(make_docs([])).count() == 0


def test_suffix_dedup_finds_anchors_once(make_docs, capsys):
    """The repeated places are stored; what reads them does not cut the texts into anchors again."""
    rows = sample_texts()
    docs = make_docs(rows)
    suffix_dedup.reported(docs).explain("simple")
    # unpacked for samples, equal and unlike places; surroundings; the cut
    assert capsys.readouterr().out.count("MapInPandas") == 5
    places = docs.sparkSession.createDataFrame([(i, i % 7, -i, i % 2 == 0) for i in range(30_000)], "rid long, pos int, ctx long, same boolean")
    held = suffix_dedup.packed(places)
    assert held.count() < 50 and suffix_dedup.unpacked(held).exceptAll(places).count() == 0 and suffix_dedup.unpacked(held).count() == 30_000


def test_blind_trie():
    rng = random.Random(6)
    rows = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(200)]
    order, common_ = suffix_dedup.blind_trie_order(rows, 12)
    ordered = [rows[i] for i in order]
    assert ordered == sorted(rows)
    assert common_[1:] == [next((k for k in range(12) if a[k] != b[k]), 12) for a, b in zip(ordered, ordered[1:])]


def test_licenses(make_docs):
    rows = [(1, "CC-BY and cc by cc by. All rights reserved"), (2, None), (3, ""), (4, "x " * 500 + "Licensed under CC BY-NC 4.0."), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "éCC by")]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scanned(make_docs(rows).select("doc_id", "text")).collect()}
    assert got[1] == (10, 4, 0, 7, "cc-by,reserved", "cc-by,reserved", 1.0, None)
    assert got[2] == got[3] == (0, 0, None, None, "", "", 0.0, None)
    # relatives that share six of seven words meet the threshold as well; the share names the notice itself
    assert got[4] == (507, 1, 502, 502, "cc-by", "cc-by,cc-by-nc,cc-by-nd,cc-by-sa", 1.0, "cc-by-nc")
    assert got[5] == (12, 1, 7, 7, "gpl", "gpl,gpl-2.0,gpl-3.0,lgpl", 1.0, "gpl-3.0") and got[6][:2] == (2, 0)
    assert licenses.scanned(make_docs([]).select("doc_id", "text")).count() == 0


def test_licenses_find_every_block_over_the_threshold(make_docs):
    """Texts made of shuffled, thinned and padded templates, beside every block compared with every template."""
    rng = random.Random(9)
    templates = {label: text.split() for label, text in licenses.TEMPLATES.items()}
    rows = [(0, "this work is licensed under the gnu general public license")]
    for i in range(1, 160):
        label = rng.choice(sorted(templates))
        words = [w for w in templates[label] if rng.random() < rng.choice([0.7, 0.85, 0.95, 1.0])]
        for _ in range(rng.choice([0, 0, 5, 40])):
            words.insert(rng.randint(0, len(words)), rng.choice(WORDS))
        rows.append((i, " ".join([*prose(rng, rng.randint(0, 300)).split(), *words, *prose(rng, rng.randint(0, 90)).split()])))
    expected = {}
    for d, text in rows:
        words, met = text.split(), set()
        for label, own in templates.items():
            block = next(b for b in licenses.BLOCKS if 2 * len(own) <= b)
            most = max(len(set(own) & set(words[i : i + block])) for i in range(0, len(words), block // 2))
            if most >= math.ceil(licenses.THRESHOLD * len(set(own))):
                met.add(label)
        joined = f" {text} "
        met |= {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in joined}
        expected[d] = ",".join(sorted(met))
    got = {r.doc_id: r.labels for r in licenses.scanned(make_docs(rows).select("doc_id", "text")).collect()}
    assert got == expected and "gpl-2.0" in got[0] and sum("-text" in x or "-header" in x for x in got.values()) > 20


def test_byte_bpe(make_docs):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["".join(rng.choice(" \t\n'sretvldmL1!é😀") for _ in range(rng.randint(0, 200))) for _ in range(300)] + [None, "", "abc" * 900]
    df = byte_bpe.decoded(byte_bpe.encoded(make_docs(list(enumerate(texts))), "text", ranks), "tokens.ids", ranks)
    for r in df.collect():
        assert r.tokens.ids == theirs.encode_ordinary(r.text or "") and bytes(r.bytes) == (r.text or "").encode()
        assert len(r.tokens.offsets) == len(r.tokens.ids)


def test_mixing(make_docs):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "é", None])) for i in range(400)]
    rows += [(400, None, "a"), (5, "again", rows[5][2])]
    docs = make_docs(rows)
    got = mixing.taken(docs).collect()
    sizes, weights = Counter(), {}
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[i % 3]
    target, open_, rest = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        w = sum(weights[s] for s in open_)
        full = {s for s in open_ if rest * weights[s] / w > 2 * sizes[s]}
        if not full:
            target |= {s: rest * weights[s] / w for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2 * sizes[s] for s in full)
        open_ -= full
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.03 * target[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs.repartition(7)).collect()))
    out = mixing.repeated(docs)
    assert out.columns == docs.columns and sum(len((r.text or "").split()) for r in out.collect()) == sum(taken.values())
    assert mixing.taken(make_docs([])).count() == 0


def test_mixing_tells_equal_ids_apart_by_text(make_docs):
    """Rows equal in doc_id, source and size are taken alike however they are dealt out."""
    rows = [(7, f"w{i} x y", "a") for i in range(50)] + [(8, "z " * 60, "b")]
    once = lambda docs: sorted((r.text, 1) for r in mixing.repeated(docs).collect())
    assert once(make_docs(rows)) == once(make_docs(rows[::-1]).repartition(5))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = common.table(spark, folder, "documents")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert i == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert docs.count() > 0


def test_rows_that_share_a_doc_id_lose_only_their_own_lines(make_docs):
    a, b = "The first line of a document that is long enough", "Quite another text that occurs only once in all of them"
    got = line_dedup.cleaned(make_docs([(1, a), (2, a), (2, b)])).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == [(1, a), (2, b)]
    removed = {(r["doc_id"], r["n_lines"]): r["removed_lines"] for r in line_dedup.reported(make_docs([(1, a), (2, a), (2, f"{b}\n{a}")])).collect()}
    assert removed == {(1, 1): "", (2, 1): "0", (2, 2): "1"}
