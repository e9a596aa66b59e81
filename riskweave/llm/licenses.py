"""License scan: phrase positions, and an exact set-similarity join of text blocks with license templates.

A block is a line of up to a window of words, or a window of the text's words, whatever its lines: windows are twice as long as the longest ``SPREAD`` of a template
(1.5 times its words) and step by half, so that no statement of this spread is cut, wherever lines break. In a window the common words must stand within the template's spread.
A template is found in a block when the block holds at least ``threshold`` of the
template's distinct words. Words are ordered by the number of texts that hold them over the whole corpus, rarest
first. A template needs ``need = ceil(threshold * size)`` common words, so
one of its first ``size - need + 1`` words must be among the block's first ``n - need + 1`` template words (prefix filter); blocks
with fewer than ``need`` template words are out (length filter); texts that hold none of the templates' first words form no blocks; and a common word at places i and j leaves at most
``1 + min(size - i, n - j)`` common words (positional filter). What passes is verified on the whole sets. No Python runs on executors.

Defined results: a null text counts as empty; empty texts have no words, null first_word and last_word, empty labels
and score 0; texts of any length are read whole; repeated rows each give a row; an empty table gives an empty result; further columns stay, but a result replaces a column of its name.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm._columns import guarded

# fixed values: phrases and labels of the base, and statements of common licenses
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words that a statement may take in a window, by words of its template.
SPREAD = 1.5
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LINE = r"\n"


def _tokens(text: str) -> list[str]:
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(_SEPARATORS, folded) if w]


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _split(text: Column) -> Column:
    return F.filter(F.split(text, _SEPARATORS), lambda w: w != "")


def _held(text: Column, words: Column, known: Column, rare: Column, least: int, spread: int) -> Column:
    """(line, its template words, null) of the lines, and (null, its template words, all its words) of the windows, that hold a word of the templates' prefixes and as many template words as some template needs."""
    none = F.lit(None).cast("array<string>")
    lines = F.filter(F.transform(F.split(_lowered(text), _LINE), lambda line, i: F.struct(i.alias("line"), _split(line).alias("run"))), lambda b: (F.size(b["run"]) <= 2 * spread) & F.arrays_overlap(b["run"], rare))
    lines = F.transform(lines, lambda b: F.struct(b["line"].alias("line"), F.array_intersect(b["run"], known).alias("_held"), none.alias("run")))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)), F.lit(spread)), lambda i: F.slice(words, i, 2 * spread))
    windows = F.transform(F.filter(windows, lambda w: F.arrays_overlap(w, rare)), lambda w: F.struct(F.lit(None).cast("int").alias("line"), F.array_intersect(w, known).alias("_held"), w.alias("run")))
    blocks = F.filter(F.concat(lines, windows), lambda b: F.size(b["_held"]) >= least)
    return F.when(F.arrays_overlap(words, rare), blocks).otherwise(F.array().cast("array<struct<line:int,_held:array<string>,run:array<string>>>"))


def places(words: Column, phrase: list[str]) -> Column:
    """Starts, from 0, at which the phrase's words stand one after another."""

    def start(word: Column, i: Column) -> Column:
        fits = word == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            fits &= F.coalesce(F.get(words, i + k) == other, F.lit(False))
        return F.when(fits, i)

    found = F.filter(F.transform(words, start), lambda i: i.isNotNull())
    return F.when(F.array_contains(words, phrase[-1]), found).otherwise(F.array().cast("array<int>"))


def order_words(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words by the number of texts (words array) that hold them, rarest first, ties by word; at most one row a word comes to the driver."""
    known = F.array(*map(F.lit, vocabulary))
    counts = {r["word"]: r["n"] for r in words.select(F.explode(F.array_intersect("words", known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, found (templates: label, line or null for a window, score), labels, score."""
    spark = docs.sparkSession
    sets = [(k, label, sorted(set(_tokens(body)))) for k, (label, body) in enumerate(templates)]
    needs = [math.ceil(threshold * len(words) - 1e-9) for _, _, words in sets]
    least = min(needs)
    spreads = [max(len(words), math.ceil(SPREAD * len(_tokens(body)))) for (_, body), (_, _, words) in zip(templates, sets, strict=True)]
    vocabulary = sorted({w for _, _, words in sets for w in words})
    known = F.array(*map(F.lit, vocabulary))

    order = order_words(docs.select(_split(_lowered(F.col(text))).alias("words")), vocabulary)
    place = {w: i for i, w in enumerate(order)}

    ordered = F.array(*map(F.lit, order))
    prefixes = []
    for (k, label, words), need, spread in zip(sets, needs, spreads, strict=True):
        mine = sorted(words, key=place.get)
        prefixes += [(mine[i], k, label, len(mine), need, i + 1, spread, mine) for i in range(len(mine) - need + 1)]
    rare = F.array(*map(F.lit, sorted({p[0] for p in prefixes})))
    # one row for each prefix word of each template: bounded by the templates, which are given
    index = F.broadcast(spark.createDataFrame(prefixes, "word string, template int, label string, size int, need int, at_template int, spread int, words array<string>"))

    work, restore = guarded(docs, {"_text": text})
    lowered, held = _lowered(F.col("_text")), _held(F.col("_text"), F.col("_words"), known, rare, least, max(spreads))
    words = _split(lowered)
    starts = F.flatten(F.array(*[places(F.col("_words"), p.split(" ")) for p, _ in phrases]))
    base = (
        work.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_words", words)
        .withColumn("_blocks", held)
        .withColumn("_starts", starts)
        .select(
            "_rest",
            "_row",
            F.size("_words").cast("bigint").alias("n_words"),
            F.size("_starts").cast("bigint").alias("n_base"),
            F.array_min("_starts").cast("bigint").alias("first_word"),
            F.array_max("_starts").cast("bigint").alias("last_word"),
            F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(places(F.col("_words"), p.split(" "))) > 0, F.lit(label)) for p, label in phrases])))).alias("_base"),
            "_blocks",
        )
    )
    keys = ["_row", "_rest", "n_words", "n_base", "first_word", "last_word", "_base"]
    # rarest first: array_intersect keeps the order of its first argument
    block = base.select(*keys, F.explode_outer("_blocks").alias("_b")).select(*keys, F.col("_b.line").alias("line"), F.array_intersect(ordered, F.col("_b._held")).alias("_held"), F.col("_b.run").alias("run"))
    prefix = F.slice(F.col("_held"), 1, F.greatest(F.lit(1), F.size("_held") - least + 1))
    probes = block.select(*keys, "line", "_held", "run", F.posexplode_outer(prefix).alias("at_block", "word"))
    pairs = probes.join(index, "word", "left")
    n, j = F.size("_held"), F.col("at_block") + 1
    passes = (j <= n - F.col("need") + 1) & (n >= F.col("need")) & (1 + F.least(F.col("size") - F.col("at_template"), n - j) >= F.col("need"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("run") - F.col("spread") + 1))
    within = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.col("words"), F.slice(F.col("run"), i, F.col("spread"))))))
    common = F.when(F.size(F.array_intersect("words", "_held")) < F.col("need"), F.lit(0)).when(F.col("run").isNull(), F.size(F.array_intersect("words", "_held"))).otherwise(within)
    verified = F.when(passes & (common >= F.col("need")), F.struct("label", "line", (common / F.col("size")).alias("score")))
    rests = [c for c in keys if c not in ("_row", "_rest")]
    out = pairs.groupBy("_row", *rests).agg(F.first("_rest").alias("_rest"), F.array_sort(F.collect_set(verified)).alias("found"))
    out = (
        out.withColumn("base_labels", F.array_join("_base", ","))
        .withColumn("labels", F.array_join(F.array_sort(F.array_union("_base", F.col("found.label"))), ","))
        .withColumn("score", F.coalesce(F.array_max(F.col("found.score")), F.lit(0.0)))
        .withColumn("_text", F.lit(None))
    )
    return restore(out, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "found"]).drop(text)


def _sql() -> str:
    """DuckDB: every line against every template, without the filters."""
    rows = ", ".join(f"({k}, '{label}', {sorted(set(_tokens(body)))})" for k, (label, body) in enumerate(TEMPLATES))
    phrase = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM (SELECT r, words, unnest(range(len(words))) AS i FROM w) WHERE " + " AND ".join(f"words[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split(" "))) for p, label in PHRASES
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words, string_split(t, chr(10)) AS lines FROM d),
p AS ({phrase}),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS base FROM p GROUP BY r),
t(k, label, words) AS (VALUES {rows}),
x AS (SELECT r, list_distinct(regexp_extract_all(unnest(lines), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS block FROM w),
m AS (SELECT r, label, len(list_intersect(block, t.words)) / len(t.words)::DOUBLE AS score FROM x, t
      WHERE len(list_intersect(block, t.words)) >= ceil(0.8 * len(t.words) - 1e-9)),
g AS (SELECT r, list_distinct(list(label)) AS labels, max(score) AS score FROM m GROUP BY r)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(g.labels, [])))), ','), '') AS labels,
  coalesce(g.score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (r) LEFT JOIN g USING (r)
"""


SQL = _sql()
