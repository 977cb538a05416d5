"""License scans by diagonal voting.

Texts and license templates are cut into rolling k-grams of words. A join of all gram hashes to their
places in the templates gives votes, each on a diagonal: the place in the text less that in the template.
Votes are counted per text, template and diagonal; diagonals a few words apart, as insertions and
deletions leave them, are merged; merged spans with enough votes are candidates, whose words are then
compared one by one with the template's along the span's diagonals. A span counts if enough of the template's
words stand in it, and densely enough. DataFrame functions only.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm._common import ascii_lower, materialise, table

# Words are runs of characters other than these; the phrases that must be found, with their labels.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Public license notices, and the whole texts of short licenses.
TEMPLATES = {
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit-line": "This project is licensed under the terms of the MIT license.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}
# The whole texts of long licenses, a file each.
TEMPLATES |= {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
#: Words in a gram; how far apart merged diagonals may lie; the least share of a template's grams in a candidate, and of its words in a span.
K, SLACK, MIN_GRAMS, MIN_SHARE = 4, 3, 0.5, 0.6
#: Candidates up to this many are broadcast, at about 200 bytes each; more are joined to their texts by shuffling.
BROADCAST_SPANS = 200_000
#: Words of all templates, the most that a broadcast table of their grams may stand for.
MOST_TEMPLATE_WORDS = 1_000_000


def license_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null is empty."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def grams(words: Column, k: int) -> Column:
    """Hash of the k words from each place on; places too near the end are left out."""
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))))
    return F.slice(hashes, 1, F.greatest(F.size(words) - (k - 1), F.lit(0)))


def phrase_places(words: Column, text: Column, phrases: tuple = PHRASES) -> Column:
    """array<struct<at, label>> of the places where a phrase's words stand in a row."""
    found = []
    for phrase, label in phrases:
        first, *rest = phrase.split()
        at = F.transform(words, lambda w, i: F.when(w == first, i))  # noqa: B023
        at = F.filter(at, lambda i: i.isNotNull() & F.coalesce(_all(*(F.get(words, i + j + 1) == r for j, r in enumerate(rest))), F.lit(False)))  # noqa: B023
        found.append(F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))))  # noqa: B023
    some = F.coalesce(_any(*(F.contains(ascii_lower(text), F.lit(p.split()[-1])) for p, _ in phrases)), F.lit(False))
    return F.when(some, F.concat(*found)).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))


def _all(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def template_words(templates: dict[str, str], k: int = K) -> list[tuple[str, list[str]]]:
    """(name, words) of each template. A template of fewer words than a gram, or more words than a broadcast bears, is refused."""
    rows = [(name, re.sub(NOT_WORD, " ", text.translate({c: c + 32 for c in range(65, 91)})).split()) for name, text in sorted(templates.items())]
    if short := [name for name, w in rows if len(w) < k]:
        raise ValueError(f"templates of fewer than {k} words: {short}; give them as phrases")
    if sum(len(w) for _, w in rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of over {MOST_TEMPLATE_WORDS} words in all")
    return rows


def votes(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, templates: dict[str, str], k: int = K, slack: int = SLACK, min_grams: float = MIN_GRAMS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, text_hash, template, first, last, share): the verified spans, places in words from 0; share is that of the template's words.

    The table of template grams is broadcast; template_words bounds its size. Null and empty texts have no
    spans; rows that repeat an id and text have the same, once. No rows give no rows.
    """
    text = F.col(f"`{text_col}`")
    t = spark.createDataFrame(template_words(templates, k), "template string, tw array<string>")
    ours = t.select("template", F.size("tw").alias("words"), F.posexplode(grams(F.col("tw"), k)).alias("at", "hash"))
    # the words are a column of their own, or each place that refers to them would split the text again
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_hash(text).alias("text_hash"), license_words(text).alias("w"))
    rows = rows.select("id", "text_hash", F.posexplode(grams(F.col("w"), k)).alias("pos", "hash"))
    hits = rows.join(F.broadcast(ours), "hash")
    diagonal = hits.groupBy("id", "text_hash", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.min("words").alias("words"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("at"))
    order = W.partitionBy("id", "text_hash", "template").orderBy("diagonal")
    starts = (F.col("diagonal") - F.lag("diagonal").over(order) > slack).cast("int")
    merged = diagonal.withColumn("span", F.coalesce(F.sum(F.coalesce(starts, F.lit(0))).over(order), F.lit(0)))
    spans = merged.groupBy("id", "text_hash", "template", "span").agg(F.min("words").alias("words"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), F.collect_set("diagonal").alias("diagonals"))
    spans = materialise(spark, spans.where(F.col("n") >= min_grams * (F.col("words") - (k - 1))).drop("n", "span"), "spans")
    spans = spans.join(F.broadcast(t.withColumnRenamed("template", "name")), F.col("template") == F.col("name")).drop("name")
    if spans.count() <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    own = docs.select(F.col(f"`{id_col}`").alias("of"), text_hash(text).alias("hash_of"), text.alias("text"))
    both = own.join(spans, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash_of"))).withColumn("w", license_words(F.col("text")))
    # only the span's words are looked at, each against the places that the span's diagonals give it
    both = both.select("id", "text_hash", "template", "first", "last", "words", "tw", "diagonals", F.slice("w", F.col("first") + 1, F.col("last") - F.col("first") + 1).alias("w"))
    both = both.select("*", F.inline(F.array(F.struct(F.col("w").alias("span_words")))))
    stands = lambda c, i: F.exists("diagonals", lambda d: (i + d >= F.col("first")) & (F.get("span_words", (i + d - F.col("first")).cast("int")) == c))
    share = F.size(F.filter("tw", lambda c, i: F.coalesce(stands(c, i), F.lit(False)))) / F.col("words")
    both = both.select("id", "text_hash", "template", "first", "last", "words", F.inline(F.array(F.struct(share.alias("share")))))
    dense = F.col("share") * F.col("words") * 2 >= F.col("last") - F.col("first") + 1
    return both.where((F.col("share") >= min_share) & dense).select("id", "text_hash", "template", "first", "last", "share").distinct()


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(id, n_words, places, spans): one row per row of docs.

    places are the phrases' (at, label), spans the templates' (template, first, last, share). Null and empty
    texts have no words and find nothing. Rows that repeat an id and text are equal; a null id is a row
    like others. No rows give no rows.
    """
    text = F.col(f"`{text_col}`")
    base = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), license_words(text).alias("w"))
    base = base.select("id", text_hash(F.col("text")).alias("text_hash"), F.size("w").cast("long").alias("n_words"), phrase_places(F.col("w"), F.col("text")).alias("places"))
    found = votes(spark, docs, id_col, text_col, TEMPLATES if templates is None else templates)
    found = found.groupBy("id", "text_hash").agg(F.collect_list(F.struct("template", "first", "last", "share")).alias("spans"))
    found = found.select(F.col("id").alias("of"), F.col("text_hash").alias("hash_of"), "spans")
    both = base.join(found, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash_of")), "left")
    return both.select("id", "n_words", "places", F.coalesce("spans", F.array().cast("array<struct<template:string,first:int,last:int,share:double>>")).alias("spans"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and verified license spans of each row of `documents`."""
    found = scan(spark, table(spark, sf_dir, "documents"))
    at = F.transform("places", lambda p: p["at"])
    labels = F.transform("places", lambda p: p["label"])
    more = F.transform("spans", lambda s: s["template"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        listed(labels).alias("base_labels"),
        listed(F.concat(labels, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """The same scan in SQL; templates are written out as texts of their words."""
    rows = ", ".join("('{}', string_split('{}', ' '))".format(name, " ".join(w)) for name, w in template_words(TEMPLATES))
    gram = lambda a, i: " || ' ' || ".join(f"{a}[{i} + {j}]" for j in range(K))
    phrase = " UNION ALL ".join("SELECT doc_id, i - 1 AS wpos, '{}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {}".format(label, " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split()))) for p, label in PHRASES)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(template, w) AS (VALUES {rows}),
tg AS (SELECT template, i - 1 AS tpos, len(w) AS words, {gram("w", "i")} AS g FROM (SELECT template, w, unnest(range(1, len(w) - {K - 2})) AS i FROM t)),
dg AS (SELECT doc_id, i - 1 AS pos, {gram("w", "i")} AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {K - 2}))) AS i FROM d)),
hits AS (SELECT doc_id, template, pos - tpos AS diagonal, pos, tpos, words FROM dg JOIN tg USING (g)),
diagonal AS (SELECT doc_id, template, diagonal, min(words) AS words, min(pos) AS first, max(pos) AS last FROM hits GROUP BY ALL),
merged AS (SELECT *, sum(CASE WHEN diagonal - prev > {SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS prev FROM diagonal)),
places AS (SELECT m.doc_id, m.template, m.span, count(DISTINCT h.tpos) AS n FROM merged m JOIN hits h USING (doc_id, template, diagonal) GROUP BY ALL),
candidates AS (SELECT * FROM (SELECT doc_id, template, span, min(words) AS words, min(first) AS first, max(last) + {K - 1} AS last FROM merged GROUP BY ALL) JOIN places USING (doc_id, template, span) WHERE n >= {MIN_GRAMS} * (words - {K - 1})),
tw AS (SELECT template, w[i] AS word, i - 1 AS tpos FROM (SELECT template, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
dw AS (SELECT doc_id, w[i] AS word, i - 1 AS pos FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE doc_id IN (SELECT doc_id FROM candidates))),
verified AS (SELECT c.doc_id, c.template, c.span, min(c.words) AS words, min(c.first) AS first, min(c.last) AS last, count(DISTINCT tw.tpos) AS n FROM candidates c JOIN merged m USING (doc_id, template, span) JOIN tw USING (template) JOIN dw ON dw.doc_id = c.doc_id AND dw.pos = tw.tpos + m.diagonal AND dw.word = tw.word WHERE dw.pos BETWEEN c.first AND c.last GROUP BY ALL),
spans AS (SELECT doc_id, template, n / words AS share FROM verified WHERE n / words >= {MIN_SHARE} AND n * 2 >= last - first + 1),
base AS ({phrase}),
b AS (SELECT doc_id, count(*) AS n_base, min(wpos) AS first_word, max(wpos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, template FROM spans) GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""


SQL = _sql()
