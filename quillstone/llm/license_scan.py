"""License scan: an exact set-similarity join of text blocks with license templates.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. Templates
have any length: they are dealt into classes of at most `half` words (SHORT and its
doubles), and a class has text blocks of its own, 2 * half consecutive words, one beginning every
half words, so that any of its templates that stands in a text lies in one block whole. A
block matches a template of its class if it has at least CONTAINMENT of the template's
distinct words. The join finds every such pair:

* the templates' words are ordered by their document frequency over all documents,
  rarest first, and blocks and templates are sorted in that order;
* prefix filter: to share `need` words, a template of n words and a block of m must
  share one of the first n - need + 1 and of the first m - need + 1;
* length filter: a block with fewer than `need` template words is out;
* positional filter: a shared word at places i and j leaves at most
  1 + min(n - i - 1, m - j - 1) shared words from there on;
* the pairs that remain are verified by the size of their intersection.

Words outside a class's templates cannot be shared and are left out of its blocks. The
index of template prefixes is broadcast while it has at most MAX_INDEX entries, else Spark
joins it by the word. Everything is DataFrame functions; the words of a text stay in its row.

A template whose shared words are all among those of another one of its class that, in the same
block or one beside it, is contained as well or better, and shares more, gives no label (a GPL line
is also mostly a line of another GPL version). Phrases, searched over the whole text, give the base columns.

Defined results: null and empty texts have no words, no labels and score 0. Repeated
rows give equal rows, an empty table an empty result. Columns beside doc_id and text
are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: (label, template): how licenses are usually stated, and whole texts of short ones. Fixed values.
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl-2.1", "this work is licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3", "this work is licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
        be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software"""),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
        the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
        liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of
        this software"""),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
        are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors
        as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
        special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
        profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including
        negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
]

CONTAINMENT = 0.8
#: Words of the templates of the first class; each further one has twice as many.
SHORT = 24
MAX_INDEX = 50_000


def normalised(text: Column) -> Column:
    """The words of a text, one space between them and at both ends."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NO_WORD, " ")), F.lit(" "))


def split_words(clean: Column) -> Column:
    return F.when(F.length(clean) > 2, F.split(F.trim(clean), " ")).otherwise(F.array().cast("array<string>"))


def places(clean: Column, words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively; only texts that have the phrase are searched word by word."""
    parts = phrase.split()
    start = F.sequence(F.lit(0), F.size(words) - len(parts))
    here = F.filter(start, lambda i: reduce(lambda a, b: a & b, [words[i + k] == w for k, w in enumerate(parts)]))
    return F.when(F.contains(clean, F.lit(f" {phrase} ")), here).otherwise(F.array().cast("array<int>"))


def half_of(n: int) -> int:
    """The class of a template of n words."""
    half = SHORT
    while half < n:
        half *= 2
    return half


def template_sets(templates: list[tuple[str, str]], threshold: float) -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, how many of them a block needs, class)."""
    out = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        if not words:
            raise ValueError(f"template {number} has no word")
        distinct = list(dict.fromkeys(words))
        out.append((number, label, distinct, math.ceil(threshold * len(distinct) - 1e-9), half_of(len(words))))
    return out


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' words by document frequency over all documents, rarest first."""
    words = split_words(normalised(docs["text"]))
    found = docs.select(F.explode(F.array_intersect(words, F.lit(vocabulary))).alias("word"))
    count = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): every row of `docs` with its base columns and a row number; every (row, block, template) of the join."""
    sets = template_sets(templates, threshold)
    order = global_order(docs, sorted({w for _, _, words, _, _ in sets for w in words}))
    rank = {w: i for i, w in enumerate(order)}
    sorted_sets = [(n, label, sorted(words, key=rank.get), need, half) for n, label, words, need, half in sets]

    words = F.col("_words")

    def likely(half: int) -> Column:
        """The blocks of a class that may match: of texts with a prefix word, those with enough of its words."""
        mine = [t for t in sorted_sets if t[4] == half]
        own = sorted({w for _, _, t, _, _ in mine for w in t}, key=rank.get)
        prefixes = sorted({w for _, _, t, need, _ in mine for w in t[:len(t) - need + 1]}, key=rank.get)
        least = min(need for *_, need, _ in mine)
        starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(half))
        blocks = F.transform(starts, lambda s: F.struct(F.lit(half).alias("half"), s.alias("start"), F.array_intersect(F.lit(own), F.slice(words, s + 1, 2 * half)).alias("words")))
        return F.when(F.arrays_overlap(words, F.lit(prefixes)), F.filter(blocks, lambda b: F.size(b["words"]) >= least))

    none = F.array().cast("array<struct<half:int,start:int,words:array<string>>>")
    every = F.concat(*[F.coalesce(likely(half), none) for half in sorted({t[4] for t in sorted_sets})])
    phrase_places = {label: places(F.col("_clean"), words, phrase) for phrase, label in PHRASES}
    rows = (
        docs.select("doc_id", normalised(docs["text"]).alias("_clean"))
        .withColumn("_words", split_words(F.col("_clean")))
        .select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", F.size(words).cast("long").alias("n_words"),
            *[c.alias(f"_at_{label}") for label, c in phrase_places.items()], every.alias("_blocks"),
        )
    )
    rows = stored(rows, "license-rows")

    entries = [
        (n, label, t, need, half, i, w) for n, label, t, need, half in sorted_sets for i, w in enumerate(t[:len(t) - need + 1])
    ]
    schema = "template int, label string, t_words array<string>, need int, half int, i int, word string"
    index = docs.sparkSession.createDataFrame(entries, schema)
    index = F.broadcast(index) if len(entries) <= MAX_INDEX else index
    blocks = rows.select("_row", F.explode("_blocks").alias("b")).select("_row", "b.half", "b.start", F.col("b.words").alias("b_words"))
    probes = blocks.select("_row", "half", "start", "b_words", F.posexplode("b_words").alias("j", "word"))
    left = 1 + F.least(F.size("t_words") - F.col("i") - 1, F.size("b_words") - F.col("j") - 1)
    pairs = (
        probes.join(index, ["word", "half"])
        .where((F.size("b_words") >= F.col("need")) & (F.col("j") <= F.size("b_words") - F.col("need")) & (left >= F.col("need")))
        .dropDuplicates(["_row", "start", "template"])
    )
    shared = pairs.withColumn("shared", F.array_intersect("t_words", "b_words"))
    matches = shared.where(F.size("shared") >= F.col("need")).select(
        "_row", "half", "start", "template", "label", "shared", (F.size("shared") / F.size("t_words")).alias("containment")
    )
    return rows, matches


def labelled(matches: DataFrame) -> DataFrame:
    """For each row its labels and its best containment; a block and its neighbours have at most three matches a template."""
    near = matches.withColumn("at", F.explode(F.array(F.col("start") - F.col("half"), F.col("start"), F.col("start") + F.col("half"))))
    block = near.groupBy("_row", "half", "at").agg(F.collect_list(F.struct("label", "shared", "containment", (F.col("at") == F.col("start")).alias("own"))).alias("m"))
    beaten = lambda a: F.exists("m", lambda b: (b["containment"] >= a["containment"]) & (F.size(b["shared"]) > F.size(a["shared"])) & (F.size(F.array_except(a["shared"], b["shared"])) == 0))
    best = block.select("_row", F.explode(F.filter("m", lambda a: a["own"] & ~beaten(a))).alias("a"))
    return best.groupBy("_row").agg(F.collect_set("a.label").alias("_labels"), F.max("a.containment").alias("_best"))


def joined(labels: Column) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(labels)), ",")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, matches = scan(read(spark, sf_dir, "documents"))
    found = rows.drop("_blocks").join(labelled(matches), "_row", "left")
    names = [label for _, label in PHRASES]
    everywhere = F.flatten(F.array(*[F.col(f"_at_{n}") for n in names]))
    base = F.filter(F.array(*[F.when(F.size(F.col(f"_at_{n}")) > 0, F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return found.select(
        "doc_id", "n_words", F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"), F.array_max(everywhere).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    values = ", ".join(f"({n}, '{label}', {words!r}, {half})" for n, label, words, _, half in template_sets(TEMPLATES, CONTAINMENT))
    at = "\n".join(
        f", list_filter(range(0, len(words) - {len(p.split()) - 1}), lambda i: list_slice(words, i + 1, i + {len(p.split())}) = {p.split()!r}) AS at_{k}"
        for k, (p, _) in enumerate(PHRASES)
    )
    base = ", ".join(f"CASE WHEN len(at_{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(PHRASES))
    every = " || ".join(f"at_{k}" for k in range(len(PHRASES)))
    return f"""
WITH templates(template, label, t_words, half) AS (VALUES {values}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(COALESCE(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
based AS (SELECT r, doc_id, words {at} FROM texts),
blocks AS (
  SELECT r, s, half, list_slice(words, s + 1, s + 2 * half) AS b_words
  FROM texts, (SELECT DISTINCT half FROM templates), unnest(range(0, len(words), half)) AS u(s)),
pairs AS (
  SELECT r, s, half, label, list_filter(t_words, lambda w: list_contains(b_words, w)) AS shared, len(t_words) AS n
  FROM blocks JOIN templates USING (half)
  WHERE len(list_filter(t_words, lambda w: list_contains(b_words, w))) >= {CONTAINMENT} * len(t_words) - 1e-9),
best AS (
  SELECT * FROM pairs a WHERE NOT EXISTS (
    SELECT 1 FROM pairs b WHERE b.r = a.r AND b.half = a.half AND abs(b.s - a.s) <= a.half AND len(b.shared) / b.n >= len(a.shared) / a.n
      AND len(b.shared) > len(a.shared) AND len(list_filter(a.shared, lambda w: NOT list_contains(b.shared, w))) = 0)),
found AS (SELECT r, list(DISTINCT label) AS labels, max(len(shared) / n) AS best FROM best GROUP BY r),
named AS (SELECT *, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM based LEFT JOIN found USING (r))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base,
       list_min({every}) AS first_word, list_max({every}) AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || COALESCE(labels, []))), ',') AS labels,
       CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE COALESCE(best, 0)::DOUBLE END AS score
FROM named
"""


ORACLE_SQL = _sql()
