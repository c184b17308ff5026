"""Personal data: base patterns, and further spans by weak supervision.

Candidate spans beyond the base patterns get votes from labelers: a strict form, a list of
context words, the character mix, the surroundings, and a gazetteer in which the span itself
is looked up (area codes, key prefixes, specimen numbers). Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is; a span classifier (naive
Bayes over shape and surroundings) is trained on the posterior and decides.

Everything on the rows is column expressions; only counts by vote and shape pattern, whose
number the definitions bound, reach the driver.

Cases: a null text is empty; a text of any length is searched whole, in time that grows with
its length (a pattern is tried once per run of its characters, not at each of them); equal rows give equal
rows; other columns are not touched; an empty table gives an empty table, and without
candidates there is no classifier and no added span.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import stored

# The base kinds in order. Possessive forms match the same text without deep recursion; a match can
# only begin where its run of characters does, or, for e-mail, where the match before ended (\G).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
# Kinds of the method: candidates, what they need at least, and the strict form.
EXTRA = {
    "phone": (r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z-])", r"[0-9]{2}\)?[ .-][0-9]{2}", r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "secret": (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])", r"[A-Za-z0-9_-]{20}", r"[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[a-z]{2,4}[-_][A-Za-z0-9_-]{20,}"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
}
CONTEXT = r"(?i)(?:phone|tel|mobile|fax|call|contact|ssn|social|secret|token|passw|api|key|auth|credential|bearer)"
# Fixed values, the gazetteer: area codes of large towns and of free numbers, prefixes that issuers give their keys, and numbers printed as specimens.
AREA_CODES = ["201", "202", "206", "212", "213", "214", "215", "301", "303", "305", "310", "312", "313", "314", "315", "316", "317", "404", "408", "410", "412", "415",
              "416", "504", "510", "512", "514", "602", "604", "612", "614", "615", "617", "619", "702", "703", "713", "718", "719", "720", "800", "801", "808", "813",
              "816", "818", "833", "844", "855", "866", "877", "888", "901", "904", "907", "916", "917", "919"]
KEY_PREFIXES = ["AKIA", "ASIA", "AIza", "ya29", "eyJ", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "npm_", "pk_live_", "sk-", "sk_live_", "sk_test_", "xoxb-", "xoxp-"]
SPECIMENS = ["078-05-1120", "219-09-9999", "123-45-6789", "457-55-5462"]
ORDER = [*PATTERNS, "secret", "ssn"]
RUN = 256
SPAN = "array<struct<start:int,stop:int,found:string>>"


def located(text: Column, pattern: str, needs: str) -> Column:
    """Start, end (exclusive) and text of every leftmost non-overlapping match.

    Matches are placed in runs of RUN, so that no array grows match by match over a whole text.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.coalesce(F.length(pair["found"]), F.lit(0))
        grown = F.concat(state["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["found"].alias("found"))))
        return F.struct(stop.alias("at"), F.when(pair["found"].isNotNull(), grown).otherwise(state["spans"]).alias("spans"))

    def run(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("spans")), step)
        return F.get(F.transform(F.array(inner), lambda i: F.struct(i["at"].alias("at"), F.concat(state["runs"], F.array(i["spans"])).alias("runs"))), F.lit(0))

    def placed(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(RUN)), lambda i: F.slice(pairs, i, RUN))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("runs"))
        return F.flatten(F.aggregate(runs, empty, run)["runs"])

    present = text.contains(needs) if needs == "@" else text.rlike(needs)
    return F.when(present, F.get(F.transform(F.array(pairs), placed), F.lit(0))).otherwise(F.array().cast(SPAN))


def luhn(digits: Column) -> Column:
    def weighed(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    def checked(kind: str):
        return lambda s: valid(kind, s["found"])

    return {k: F.filter(located(text, p, NEEDS[k]), checked(k)) for k, p in PATTERNS.items()}


def known(kind: str, found: Column) -> Column:
    """The gazetteer's vote: 1 if the span's own characters are on the list, -1 if they are a printed specimen, else 0."""
    if kind == "phone":
        return F.when(F.substring(F.regexp_replace(found, "[^0-9]", ""), 1, 3).isin(AREA_CODES), 1).otherwise(0)
    if kind == "secret":
        listed = F.lit(False)
        for prefix in KEY_PREFIXES:
            listed |= found.startswith(prefix)
        return F.when(listed, 1).otherwise(0)
    return F.when(found.isin(SPECIMENS), -1).otherwise(0)


def candidates(text: Column, kind: str, base: list[Column]) -> Column:
    """Spans of a kind that touch no base span, with votes (1 yes, 0 none, -1 no) and the shape the classifier sees."""
    pattern, needs, strict = EXTRA[kind]

    def free(s: Column) -> Column:
        clear = F.lit(True)
        for spans in base:
            clear &= ~F.exists(spans, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))
        return clear

    def described(s: Column) -> Column:
        found = s["found"]
        size = F.length(found)
        digits, upper = F.regexp_count(found, F.lit("[0-9]")), F.regexp_count(found, F.lit("[A-Z]"))
        begin = F.greatest(s["start"] - 32, F.lit(0))
        before = F.substring(text, begin + 1, s["start"] - begin)
        left, right = F.substring(text, s["start"], 1), F.substring(text, s["stop"] + 1, 1)
        mix = {"secret": (digits >= 4) & (digits < size), "phone": digits.between(9, 15), "ssn": digits == 9}[kind]
        yes_no = lambda c, no=-1: F.when(c, 1).otherwise(no)
        votes = F.array(
            yes_no(found.rlike(f"^(?:{strict})$")), yes_no(before.rlike(CONTEXT), 0), yes_no(mix),
            F.when(left.rlike("^[\\s\"'=:(]?$") & right.rlike("^[\\s\"').,;]?$"), 1).otherwise(-1),
            known(kind, found),
        )
        char = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike("[\"'=:]"), "quote").otherwise("other")
        shape = F.array(
            F.least(F.floor(size / 8), F.lit(8)).cast("string"), F.floor(4 * digits / size).cast("string"), F.floor(4 * upper / size).cast("string"),
            char(left), char(right), F.when(before.rlike(r"[=:]\s*[\"']?$"), "assigned").otherwise("plain"),
        )
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), votes.alias("votes"), shape.alias("shape"))

    return F.transform(F.filter(located(text, pattern, needs), free), described)


def reliabilities(counts: dict[tuple, float], labelers: int, steps: int = 50) -> tuple[float, list[dict], dict[tuple, float]]:
    """EM for two classes with independent labelers: the prior, each labeler's vote rates by class, and P(real | votes)."""
    post = {v: min(max(0.5 + sum(v) / (2.0 * labelers), 0.05), 0.95) for v in counts}
    prior, rates = 0.5, []
    for _ in range(steps):
        total = sum(counts.values())
        real = sum(n * post[v] for v, n in counts.items())
        prior = (real + 1) / (total + 2)
        rates = []
        for i in range(labelers):
            rate = {}
            for vote in (-1, 0, 1):
                yes = sum(n * post[v] for v, n in counts.items() if v[i] == vote)
                all_ = sum(n for v, n in counts.items() if v[i] == vote)
                rate[vote] = ((yes + 1) / (real + 3), (all_ - yes + 1) / (total - real + 3))
            rates.append(rate)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[i][x][0] / rates[i][x][1]) for i, x in enumerate(v))
            post[v] = 1 / (1 + math.exp(-max(min(odds, 50), -50)))
    return prior, rates, post


def train(rows: list) -> dict[str, tuple[float, list[dict[str, float]]]]:
    """Per kind the classifier: a bias and a weight for every value of every shape feature."""
    out = {}
    for kind in sorted({r["kind"] for r in rows}):
        own = [(tuple(r["votes"]), tuple(r["shape"]), r["n"]) for r in rows if r["kind"] == kind]
        counts: dict[tuple, float] = defaultdict(float)
        for votes, _, n in own:
            counts[votes] += n
        _, _, post = reliabilities(counts, len(own[0][0]))
        yes = sum(n * post[v] for v, _, n in own)
        no = sum(n * (1 - post[v]) for v, _, n in own)
        weights = []
        for i in range(len(own[0][1])):
            sums: dict[str, list[float]] = defaultdict(lambda: [1.0, 1.0])
            for v, shape, n in own:
                sums[shape[i]][0] += n * post[v]
                sums[shape[i]][1] += n * (1 - post[v])
            k = len(sums)
            weights.append({x: math.log((a / (yes + k)) / (b / (no + k))) for x, (a, b) in sums.items()})
        out[kind] = (math.log((yes + 1) / (no + 1)), weights)
    return out


def _odds(c: Column, model: dict) -> Column:
    out = F.lit(-1.0)
    for kind, (bias, weights) in model.items():
        odds = F.lit(bias)
        for i, weight in enumerate(weights):
            table = F.create_map(*[F.lit(x) for kv in sorted(weight.items()) for x in kv])
            odds = odds + F.coalesce(F.try_element_at(table, c["shape"][i]), F.lit(0.0))
        out = F.when(c["kind"] == kind, odds).otherwise(out)
    return out


def found(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, counts of the base kinds, the digest of the base spans and all spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("t")).select("doc_id", "t", *[c.alias(k) for k, c in base_spans(F.col("t")).items()])
    added = F.concat(*[candidates(F.col("t"), k, [F.col(b) for b in PATTERNS]) for k in EXTRA])
    spans = stored(base.select("doc_id", *[F.transform(k, lambda s: s.dropFields("found")).alias(k) for k in PATTERNS], added.alias("added")))
    patterns = spans.select(F.explode("added").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count(F.lit(1)).alias("n")).collect()
    model = train(patterns)
    rank = {k: i for i, k in enumerate(ORDER)}
    listed = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(rank[k]).alias("rank"), s["stop"].alias("stop"), F.lit(k).alias("kind")))
    known = F.concat(*[listed(k) for k in PATTERNS])
    kind_rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), c["kind"])
    extra = F.transform(F.filter("added", lambda c: _odds(c, model) > 0), lambda c: F.struct(c["start"].alias("start"), kind_rank(c).alias("rank"), c["stop"].alias("stop"), c["kind"].alias("kind")))
    written = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return spans.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(written(known), 256).alias("base_sha256"), written(F.concat(known, extra)).alias("spans"),
    )
