"""License scan: exact set-similarity join of text blocks with license templates; DataFrame expressions only.

A-Z are lower-cased; words are runs of 0-9, a-z and everything beyond ASCII, so lines, wrapping and punctuation play
no part. A *run* is a stretch of consecutive words, twice as long as the template it is compared with (the text's last
words are shorter runs). A text holds template t if some run r has |words(r) & words(t)| >= THRESHOLD * |words(t)|, as
sets, and the template's deciding words stand in r one after the other: short templates of one family share all words
but these, so an Apache notice is no MIT notice, and CC BY-NC is not CC BY.

The join finds the runs by *blocks*: windows of the text that overlap so far that every run lies in one, four
times as long as the longest template, in steps of half of that. All template words are ordered by the number of documents that
hold them (rarest first, ties by the word), counted over the whole corpus. A block that holds a run that holds t shares
at least alpha = ceil(THRESHOLD * |t|) words with it, so it shares a word with t inside the first |b'| - alpha + 1
words of b' (its template words in that order) and the first |t| - alpha + 1 of t (prefix filter), has |b'| >= alpha
(length filter), and at their first common word both have alpha - 1 words left (positional filter). Blocks and
templates are equi-joined on prefix words, filtered, and verified run by run. Only documents that hold a prefix word
of some template are cut into blocks.

Templates are a parameter; their number and size do not follow the data. Beside the join, plain phrases are
counted wherever their words stand consecutively. Null and empty texts hold nothing, and an empty table gives an empty
one. Rows with a null id are told apart by their text; repeated rows get equal results. Of the table only the id and
the text are read, so other columns may have any name. Results do not hang on the order of rows; equal containments
of several templates all count.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .native import let

THRESHOLD = 0.8
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label of the base scan: fixed values.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Template, label and deciding words. Sentences of customary license notices: fixed values.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "apache-2.0", "apache license"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0", "apache org licenses"),
    ("Released under the MIT License", "mit", "mit license"),
    ("Licensed under the MIT license", "mit", "mit license"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", "any person obtaining a copy"),
    ("to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit", "to deal in the software"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0", "gnu general public license version 3"),
    ("This work is licensed under the GNU General Public License, version 2", "gpl-2.0", "gnu general public license version 2"),
    ("it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", "gnu general public license"),
    ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl", "lesser general public license"),
    ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl", "affero general public license"),
    ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0", "by nc sa 4"),
    ("Licensed under CC BY-NC-ND 4.0", "cc-by-nc-nd-4.0", "by nc nd 4"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0", "by nc 4"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0", "by sa 4"),
    ("Licensed under CC BY-ND 4.0", "cc-by-nd-4.0", "by nd 4"),
    ("Licensed under CC BY 4.0", "cc-by-4.0", "cc by 4"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0", "attribution 4"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0", "attribution sharealike 4"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc-4.0", "attribution noncommercial 4"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd", "source and binary forms"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-3-clause", "endorse or promote products"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc", "for any purpose with or without fee"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0", "mozilla public license"),
    ("This is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software"),
)


def all_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in text order."""
    return list(dict.fromkeys(all_words(text)))


def words_of(text: Column) -> Column:
    """The two characters beyond ASCII whose lower case is in it are put aside first: only A-Z become a-z."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ue000")), F.lit("\u0130"), F.lit("\ue001"))
    return F.array_remove(F.split(F.lower(kept), SEPARATORS), "")


def strings(values) -> Column:
    return F.array(*map(F.lit, values))


def vocabulary_by_frequency(docs: DataFrame, templates) -> list[str]:
    """All template words, rarest first, by the number of documents that hold them."""
    words = sorted({w for t, *_ in templates for w in template_words(t)})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), strings(words))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in held.collect()}  # a row a template word
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def template_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_hash, template, label, containment): every template that a document holds, and its best run's containment."""
    spark = docs.sparkSession
    order = vocabulary_by_frequency(docs, templates)
    rank = {w: i for i, w in enumerate(order)}
    longest = max((len(all_words(t)) for t, *_ in templates), default=1)
    step, size = 2 * longest, 4 * longest
    sides = []
    for k, (text, label, deciding) in enumerate(templates):
        ordered = sorted(template_words(text), key=rank.__getitem__)
        alpha = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        sides += [(w, k, label, f" {deciding} ", ordered, alpha, len(ordered) - q, 2 * len(all_words(text))) for q, w in enumerate(ordered[: len(ordered) - alpha + 1])]
    theirs = spark.createDataFrame(sides, "word string, template int, label string, deciding string, ordered array<string>, alpha int, rest_t int, run int")
    # broadcast below: a row a prefix word of a template, whatever the size of the corpus
    least = min((s[5] for s in sides), default=1)
    prefixes = sorted({s[0] for s in sides})
    holds = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("words")).filter(F.arrays_overlap("words", strings(prefixes)))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(step))
    blocks = holds.select("doc_id", "text_hash", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("block"))
    ours = blocks.select("*", F.array_intersect(strings(order), F.col("block")).alias("ours")).filter(F.size("ours") >= least)
    prefix = ours.select("*", F.posexplode(F.slice("ours", F.lit(1), F.size("ours") - least + 1)).alias("p", "word"))
    both = prefix.join(F.broadcast(theirs), "word").filter(F.size("ours") >= F.col("alpha")).filter(F.least(F.size("ours") - F.col("p"), F.col("rest_t")) >= F.col("alpha"))
    near = both.filter(F.size(F.array_intersect("ours", "ordered")) >= F.col("alpha")).filter(F.concat(F.lit(" "), F.array_join("block", " "), F.lit(" ")).contains(F.col("deciding")))

    def held(run: Column) -> Column:
        decided = F.concat(F.lit(" "), F.array_join(run, " "), F.lit(" ")).contains(F.col("deciding"))
        return F.when(decided, F.size(F.array_intersect(run, F.col("ordered"))))

    # the runs that begin in the block's first half; the others begin in the next block's
    places = F.filter(F.sequence(F.lit(1), F.least(F.size("block"), F.lit(step))), lambda i: F.array_contains("ordered", F.get("block", i - 1)))
    overlap = F.array_max(F.transform(places, lambda i: let(F.slice("block", i, F.col("run")), held)))
    exact = near.select("doc_id", "text_hash", "template", "label", "alpha", (overlap / F.size("ordered")).alias("containment"), overlap.alias("overlap")).filter(F.col("overlap") >= F.col("alpha"))
    return exact.groupBy("doc_id", "text_hash", "template").agg(F.first("label").alias("label"), F.max("containment").alias("containment"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """0-based starts of all places where the phrase's words stand consecutively."""
    parts = phrase.split()

    def at(i: Column) -> Column:
        test = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == part)
        return F.coalesce(test, F.lit(False))

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - 1), at)).otherwise(F.array().cast("array<int>"))


def phrase_scan(docs: DataFrame, phrases=PHRASES) -> DataFrame:
    """doc_id, text_hash, n_words and base: an array of (starts, label) for each phrase found, of every document."""
    none = F.array().cast("array<struct<starts:array<int>,label:string>>")

    def scan(words: Column) -> Column:
        joined = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        some = F.lit(False)
        for p, _ in phrases:
            some = some | joined.contains(f" {p} ")
        found = F.filter(F.array(*[F.struct(phrase_starts(words, p).alias("starts"), F.lit(label).alias("label")) for p, label in phrases]), lambda x: F.size(x["starts"]) > 0)
        return F.struct(F.size(words).cast("long").alias("n_words"), F.when(some, found).otherwise(none).alias("base"))

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), let(words_of(F.col("text")), scan).alias("s")).select("doc_id", "text_hash", "s.n_words", "s.base")


def op2_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and templates of every document; score: the best containment, 1 for a phrase."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = phrase_scan(docs)
    per_doc = template_matches(docs).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.count("*").alias("held"))
    same = rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["text_hash"] == per_doc["text_hash"])
    both = rows.join(per_doc, same, "left").select(rows["doc_id"], "n_words", "base", "more", "best", "held")
    starts = F.flatten(F.transform("base", lambda b: b["starts"]))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("held", F.lit(0)).cast("long").alias("n_templates"),
    )


def op2_sql() -> str:
    """The same by comparing every run of every text with every template, for DuckDB."""
    quote = "'{}'".format
    phrases = ", ".join(f"([{', '.join(map(quote, p.split()))}], '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({k}, [{', '.join(map(quote, template_words(t)))}], {2 * len(all_words(t))}, '{label}', ' {deciding} ')" for k, (t, label, deciding) in enumerate(TEMPLATES))
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{sep}'), lambda x: x <> '') AS w FROM documents),
p(pw, label) AS (VALUES {phrases}),
places AS (SELECT r, i - 1 AS s, label FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM d), p WHERE list_extract(w, i) = list_extract(pw, 1) AND w[i : i + len(pw) - 1] = pw),
base AS (SELECT r, count(*) AS n, min(s) AS lo, max(s) AS hi, list_sort(list_distinct(list(label))) AS labels FROM places GROUP BY r),
t(k, tw, run, label, deciding) AS (VALUES {templates}),
c AS (SELECT r, w, k, tw, run, label, deciding, ceil({THRESHOLD} * len(tw) - 1e-9) AS alpha FROM d, t WHERE len(list_intersect(w, tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9)),
u AS (SELECT r, k, tw, label, deciding, alpha, w[i : i + run - 1] AS x FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM c)),
m AS (SELECT r, k, label, max(len(list_intersect(x, tw)) / len(tw)) AS c FROM u WHERE len(list_intersect(x, tw)) >= alpha AND contains(' ' || array_to_string(x, ' ') || ' ', deciding) GROUP BY ALL),
md AS (SELECT r, list_distinct(list(label)) AS labels, max(c) AS best, count(*) AS held FROM m GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(md.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, CAST(coalesce(held, 0) AS BIGINT) AS n_templates
FROM d LEFT JOIN base USING (r) LEFT JOIN md USING (r)
"""
