"""Licence scan: an exact set-similarity join of text blocks with licence templates, in DataFrame operations only.

A block is a window of a text's words, a quarter longer than the template that it is compared with: a notice may be
reflowed, broken by blank lines or interrupted, but its words must stand together. A block matches a template if it holds at
least ``threshold`` of the template's distinct words. Words are ordered by the number of documents of the whole corpus that
hold them, rarest first; a text with a matching block must share a word with the template's prefix (prefix filter), must hold
enough words that any template knows (length filter), and its first shared word must leave enough words after it in both
(positional filter). In what passes, only windows around a word of the prefix can match, and they are verified by the
intersection. The templates are a fixed parameter of bounded size, so they are literals of the plan: the join is a map over
the scan, and no row is shuffled or collected but one count for each template word.

Defined results. Null and empty texts have no words, no places and no labels. Repeated rows: one result each. A word
with equal frequency as another is ordered by its spelling. Of overlapping windows that are equally good the first is the block. Texts are scanned
whole. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import pick, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases whose places count, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and whole licences as their publishers give them, by label; names and years are left out.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished"
        " to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS"
        " PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
        " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE"
        " SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language"
        " governing permissions and limitations under the License.",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General"
        " Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above"
        " copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following"
        " disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES,"
        " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY"
        " DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
        " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN"
        " IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all"
        " copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to"
        " anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a"
        " compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), NO_WORD), "")


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(NO_WORD, text.lower()) if w))


def window_of(text: str) -> int:
    """Words in a block that is compared with the template: a quarter more than it has."""
    return math.ceil(1.25 * len([w for w in re.split(NO_WORD, text.lower()) if w]))


def strings(values: list[str]) -> str:
    quoted = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return f"CAST(array({quoted}) AS ARRAY<STRING>)"


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many of all documents each of these words occurs; at most one row for each reaches the driver."""
    held = docs.select(F.explode(F.array_intersect(word_list(F.col("text")), F.array(*map(F.lit, words)))).alias("word"))
    return {w: 0 for w in words} | {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def starts_of(phrase: str) -> str:
    """SQL for the places, from 0, where the phrase's words stand consecutively in ``words``."""
    first, *rest = phrase.split()
    after = " AND ".join(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(rest, 1))
    return f"CASE WHEN array_contains(words, '{rest[-1]}') THEN filter(sequence(0, size(words) - 1), i -> get(words, i) = '{first}' AND {after}) ELSE CAST(array() AS ARRAY<INT>) END"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the highest containment), matches.

    ``matches`` holds every block that matches a template, template by template: the label, the block's containment, its first
    word (its place, from 0) and its words. Of overlapping windows that match the same template the best one is the block.
    """
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty(F.col("text")))
    sets = [(label, template_words(text), window_of(text)) for label, text in templates]
    n = frequencies(src, sorted({w for _, words, _ in sets for w in words}))
    order = sorted(n, key=lambda w: (n[w], w))
    place = {w: i for i, w in enumerate(order)}
    rows, prefixes = [], set()
    for label, words, window in sets:
        words = sorted(words, key=place.get)
        need = math.ceil(round(threshold * len(words), 9))
        prefix = words[: len(words) - need + 1]
        prefixes.update(prefix)
        rows.append(f"named_struct('label', '{label}', 'words', {strings(words)}, 'prefix', {strings(prefix)}, 'need', {need}, 'window', {window})")
    templates_sql, known, rare = f"array({', '.join(rows)})", strings(order), strings(sorted(prefixes))

    words = src.select("doc_id", word_list(F.col("text")).alias("words"))
    found = words.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), *[F.expr(starts_of(p)).alias(f"at_{label}") for p, label in PHRASES.items()],
        # the words of a text that templates know, in the global order; none if no prefix has any of them
        F.expr(f"CASE WHEN arrays_overlap(words, {rare}) THEN array_intersect({known}, words) ELSE CAST(array() AS ARRAY<STRING>) END").alias("own"),
    )
    # few texts pass for any template
    passed = found.withColumn("passed", F.expr(f"""CASE WHEN size(own) = 0 THEN filter({templates_sql}, t -> false) ELSE filter({templates_sql}, t ->
        size(own) >= t.need
        AND arrays_overlap(own, t.prefix)
        AND least(size(own) - array_position(own, array_intersect(own, t.prefix)[0]),
                  size(t.words) - array_position(t.words, array_intersect(own, t.prefix)[0])) + 1 >= t.need
        AND size(array_intersect(own, t.words)) >= t.need) END"""))  # fmt: skip
    # windows that begin with one of the template's words and reach one of its prefix; of those that match and overlap, the best
    blocks = """transform(passed, t -> named_struct('t', t, 'found', aggregate(
        filter(transform(filter(sequence(0, size(words) - 1), i -> array_contains(t.words, words[i]) AND arrays_overlap(t.prefix, slice(words, i + 1, t.window))),
                         i -> named_struct('n', size(array_intersect(t.words, slice(words, i + 1, t.window))), 'start', i)), w -> w.n >= t.need),
        CAST(array() AS ARRAY<STRUCT<n:INT,start:INT>>),
        (kept, w) -> CASE WHEN size(kept) = 0 OR w.start >= element_at(kept, -1).start + t.window THEN concat(kept, array(w))
                          WHEN w.n > element_at(kept, -1).n THEN concat(slice(kept, 1, size(kept) - 1), array(w)) ELSE kept END)))"""
    matched = passed.withColumn("blocks", F.expr(blocks)).withColumn("matches", F.expr("""flatten(transform(blocks, x -> transform(x.found, w -> named_struct('label', x.t.label,
        'score', CAST(w.n AS DOUBLE) / size(x.t.words), 'start', w.start, 'block', array_join(slice(words, w.start + 1, x.t.window), ' ')))))""")).drop("words", "own", "passed", "blocks")  # fmt: skip
    places = F.concat(*[F.col(f"at_{label}") for label in PHRASES.values()])
    base = F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in PHRASES.values()]))
    out = matched.select("doc_id", "n_words", places.alias("places"), base.alias("base"), "matches")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.transform("matches", lambda m: m["label"])))), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))).alias("score"),
        "matches",
    )


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.drop("matches")


def license_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.95) -> str:
    """The same rows by comparing every window that begins with a template's word with that template."""
    rows = ", ".join(f"({k}, '{label}', [{', '.join(repr(w) for w in template_words(text))}], {window_of(text)})" for k, (label, text) in enumerate(templates))
    split = "list_filter(string_split_regex(translate(text, '" + UPPER + "', '" + LOWER + "'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    phrases = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, unnest(list_filter(range(1, len(words) + 1), lambda i: {' AND '.join(f'words[i + {k}] = {w!r}' for k, w in enumerate(p.split()))})) - 1 AS place FROM w" for p, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {split} AS words FROM d),
t AS (SELECT *, ceil(round({threshold} * len(known), 9)) AS need FROM (VALUES {rows}) AS v(tid, label, known, size)),
c AS (SELECT rid, tid, label, words, known, size, need FROM w, t WHERE len(list_intersect(known, list_distinct(words))) >= need),
e AS (SELECT rid, tid, i, words[i] AS word FROM (SELECT rid, tid, words, known, unnest(range(1, len(words) + 1)) AS i FROM c) AS u WHERE list_contains(known, words[i])),
n AS (SELECT a.rid, a.tid, a.i, count(DISTINCT b.word) AS n FROM e a JOIN e b ON a.rid = b.rid AND a.tid = b.tid JOIN t ON t.tid = a.tid WHERE b.i >= a.i AND b.i < a.i + size GROUP BY ALL),
m AS (SELECT rid, label, max(n) / max(len(known)) AS score FROM n JOIN t USING (tid) WHERE n >= need GROUP BY rid, tid, label),
p AS ({phrases}),
a AS (SELECT rid, count(*) AS n, min(place) AS f, max(place) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY rid),
x AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM p UNION ALL SELECT rid, label FROM m) AS u GROUP BY rid),
y AS (SELECT rid, max(score) AS score FROM m GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
       coalesce(a.labels, '') AS base_labels, coalesce(x.labels, '') AS labels, CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN a USING (rid) LEFT JOIN x USING (rid) LEFT JOIN y USING (rid)
"""
