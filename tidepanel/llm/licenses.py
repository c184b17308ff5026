"""License scan: an exact containment join of text blocks with license templates.

Tokens of the templates are ordered by how many documents hold them, rarest first. A block
that holds at least the threshold of a template's tokens holds one of the template's first
few tokens (prefix filter), has enough known tokens (length filter), and the places of the
first shared token leave room for the rest (positional filter); what passes is counted
exactly. Blocks are windows of so many words every half as many, so that half a block of
consecutive words lies in one block whole: BLOCKS lists the sizes, and a template is scanned
with the smallest whose half holds it. The templates are few and travel as literals.

Every template that a block holds to the threshold gives its label. Relatives share most of
their words, so a notice often meets several: ``best_label`` is the one with the largest share,
among equals the one all of whose own marks stand in the block, then the first by name.

Cases: a null or empty text has no words and no labels; texts of any length are cut into
blocks; repeated rows are scanned alike; other columns are not touched; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators, words before lower-casing, base phrases and labels.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
THRESHOLD, BLOCKS = 0.8, (64, 512)

# What the usual notices say, by label, and the whole texts of short licenses and headers.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "released under cc0 1 0 universal public domain dedication",
    "gpl-2.0": "this work is licensed under the gnu general public license version 2",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain "
    "a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language "
    "governing permissions and limitations under the license",
    "bsd-2-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must "
    "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the "
    "distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the "
    "implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for "
    "any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use "
    "data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
    "software foundation either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without "
    "any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you "
    "should have received a copy of the gnu general public license along with this program if not see",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
    "notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software "
    "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
    "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in "
    "connection with the use or performance of this software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in "
    "the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not "
    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
    "any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
    "dealings in the software",
}
# A template's own marks tell it from near relatives; they rank, they do not exclude.
MARKS = {"cc-by-nc": ["cc", "nc"], "cc-by-nd": ["cc", "nd"], "cc-by-sa": ["cc", "sa"], "gpl-2.0": ["gnu", "2"], "gpl-3.0": ["gnu", "3"],
         "lgpl": ["lesser"], "apache-2.0": ["apache"], "mpl-2.0": ["mozilla"], "cc0": ["cc0"], "mit": ["granted"], "bsd": ["redistribution"]}


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def token_frequencies(docs: DataFrame) -> dict[str, int]:
    """Documents that hold each template token: at most one row per token reaches the driver."""
    tokens = sorted({w for t in TEMPLATES.values() for w in t.split()})
    held = F.explode(F.array_intersect(F.split(F.lower("text"), SEPARATOR), _literals(tokens)))
    counts = {r["token"]: r["n"] for r in docs.select(held.alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {t: counts.get(t, 0) for t in tokens}


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, best_label."""
    df = token_frequencies(docs)
    order = sorted(df, key=lambda t: (df[t], t))
    rank = {t: i for i, t in enumerate(order)}
    plans = {block: [] for block in BLOCKS}
    for label, text in TEMPLATES.items():
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        need = math.ceil(THRESHOLD * len(tokens))
        block = next(b for b in BLOCKS if 2 * len(text.split()) <= b)
        plans[block].append((label, tokens, need, tokens[: len(tokens) - need + 1]))
    probes = sorted({t for own in plans.values() for *_, prefix in own for t in prefix} | {p.split()[0] for p in PHRASES})

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("t"), F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    probed = F.arrays_overlap(F.split(F.lower("t"), SEPARATOR), _literals(probes))
    lowered = F.translate("t", string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lowered, SEPARATOR), lambda w: w != "")
    out = out.select("doc_id", "n_words", F.when(probed, words).otherwise(F.array().cast("array<string>")).alias("w"))
    n = F.size("w")
    # known tokens of each block, in global order
    none = F.array().cast("array<array<string>>")
    cut = {}
    for block, own in plans.items():
        wanted = _literals([t for t in order if any(t in tokens for _, tokens, *_ in own)])
        starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(block // 2))
        known = F.when(n > 0, F.transform(starts, lambda i: F.array_intersect(wanted, F.slice("w", i + 1, block))))
        cut[f"blocks{block}"] = F.filter(F.coalesce(known, none), lambda b: F.size(b) > 0)
    out = out.withColumns({"joined": F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" ")), **cut})

    def overlap(tokens: list[str], need: int, prefix: list[str]):
        whole, first = _literals(tokens), lambda b: F.element_at(F.array_intersect(_literals(prefix), b), 1)
        room = lambda b: F.least(F.lit(len(tokens) + 1) - F.array_position(whole, first(b)), F.size(b) + 1 - F.array_position(b, first(b)))

        def of(b: Column) -> Column:
            possible = (F.size(b) >= need) & F.arrays_overlap(_literals(prefix), b)
            return F.when(possible & (room(b) >= need), F.size(F.array_intersect(whole, b))).otherwise(0)

        return of

    found = []
    for block, own in plans.items():
        for label, tokens, need, prefix in own:
            marks, of = _literals(MARKS.get(label, [])), overlap(tokens, need, prefix)
            ranked = F.transform(f"blocks{block}", lambda b: F.struct(of(b).alias("n"), (F.size(F.array_intersect(marks, b)) == F.size(marks)).alias("marked")))
            best = F.array_max(ranked)
            share = F.when(best["n"] >= need, best["n"] / float(len(tokens))).otherwise(0.0)
            found.append(F.struct(F.lit(label).alias("label"), share.alias("share"), best["marked"].alias("marked")))
    spaces = lambda s: ((F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))) / 2).cast("long")  # noqa: E731  two around every word
    places = []
    for phrase, label in PHRASES.items():
        key = " " + "  ".join(phrase.split()) + " "
        count = ((F.length("joined") - F.length(F.replace(F.col("joined"), F.lit(key), F.lit("")))) / len(key)).cast("long")
        first = spaces(F.substring_index("joined", key, 1))
        last = F.col("n_words") - spaces(F.substring_index("joined", key, -1)) - len(phrase.split())
        places.append(F.struct(F.lit(label).alias("label"), count.alias("n"), first.alias("first"), last.alias("last")))
    out = out.withColumn("found", F.filter(F.when(F.size("blocks64") > 0, F.array(*found)).otherwise(F.array().cast("array<struct<label:string,share:double,marked:boolean>>")), lambda x: x["share"] > 0))
    out = out.withColumn("base", F.filter(F.array(*places), lambda p: p["n"] > 0))
    base_labels = F.transform("base", lambda p: p["label"])
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("found", lambda x: x["label"]))))
    best = F.get(F.array_sort(F.transform("found", lambda x: F.struct((-x["share"]).alias("s"), (~x["marked"]).alias("m"), x["label"].alias("label")))), F.lit(0))
    return out.select(
        "doc_id", "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)), F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"),
        best["label"].alias("best_label"),
    )
