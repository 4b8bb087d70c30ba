"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a stretch of consecutive words of a text, line breaks or not, of at most a template's `span` (a quarter more
words than the template has). It matches if it holds at least `threshold` of the template's distinct words, among them
all of its telling words, which part short templates from their neighbours (nc, sa, mit).

Words are ordered by how many documents hold them, rarest first, counted over the whole corpus. Of each template only the
prefix (the rarest n - need + 1 words) is indexed: a block that matches holds one of those, so only the surroundings of
their occurrences are looked at. Length and positional filters drop candidates before the exact count. Words in no
template or phrase can't add to an overlap, so one scan of the texts keeps the known words and their places, and all else
works on that. The index is as large as the templates, whatever the corpus.

Beside it, base phrases are found at every place where their words stand consecutively in the whole text.

Defined results: a null or empty text has no words and no labels. Each row has what its own text holds, whether its doc_id
is null or repeated. A very long text has many places, each a row of at most two spans of words. Of blocks that hold
equally much, the first is reported. An empty table gives an empty result. Only doc_id and text are read, so other columns
can't clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltable.llm.common import let, own_names, table, words_of, written

LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between such words in a text that isn't in lower case yet.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, words, telling words): notices that public licenses tell their users to put into files.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2.0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "compliance license"),
    ("apache-2.0", "distributed on an as is basis without warranties or conditions of any kind either express or implied", "warranties"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copyright permission"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0", "cc by nc"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0", "cc by sa"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4.0 international license", "creative commons attribution"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived copyright"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution permitted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
THRESHOLD = 0.8


def template_sets(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, list[str], int, int, list[str]]]:
    """(label, distinct words, words needed, span, telling words); templates without words are left out."""
    found = []
    for label, text, telling in templates:
        all_words = re.findall(LICENSE_WORD, text.lower())
        words = list(dict.fromkeys(all_words))
        if words:
            found.append((label, words, max(1, math.ceil(threshold * len(words) - 1e-9)), math.ceil(1.25 * len(all_words)), telling.split()))
    return found


def phrase_places(known: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, as starts counted from 0, told from the known words."""
    p = phrase.split()

    def start(e: Column, i: Column) -> Column:
        hit = e["w"] == p[0]
        for k in range(1, len(p)):
            nxt = F.get(known, i + k)
            hit = hit & (nxt["w"] == p[k]) & (nxt["at"] == e["at"] + k)
        return F.when(hit, e["at"])

    return F.filter(F.transform(known, start), lambda x: x.isNotNull())


def known_words(docs: DataFrame, sets, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """_row (a number of its own for each row of docs), doc_id, n_words and `known`: place and word of those of the templates and phrases. A written table."""
    vocab = sorted({w for s in sets for w in s[1]} | {w for p in phrases for w in p.split()})

    def known(w: Column, i: Column) -> Column:
        # A word with a character beyond ASCII has more bytes than what it may look like in lower case.
        low = F.lower(w)
        return F.when(low.isin(*vocab) & (F.octet_length(low) == F.octet_length(w)), F.struct(i.alias("at"), low.alias("w")))

    told = let(words_of(F.coalesce(F.col("text"), F.lit("")), BETWEEN), lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.filter(F.transform(ws, known), lambda x: x.isNotNull()).alias("known")))
    return written(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", told.alias("_t")).select("_row", "doc_id", "_t.*"))


def ordered_vocabulary(known: DataFrame, sets) -> list[str]:
    """The templates' words, those that fewest documents hold first. At most as many rows as the templates have words reach the driver."""
    vocab = sorted({w for s in sets for w in s[1]})
    held = known.select(F.explode(F.array_distinct(F.transform("known", lambda e: e["w"]))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocab, key=lambda w: (counts.get(w, 0), w))


def matches(known: DataFrame, sets) -> DataFrame:
    """_row, doc_id, template, label, start, containment: for each pair of a row of known and a template that some block matches, the best block's first word and its share."""
    spark, order = known.sparkSession, ordered_vocabulary(known, sets)
    rank = {w: i for i, w in enumerate(order)}
    reach = max(s[3] for s in sets)
    postings, full = [], []
    for t, (label, words, need, span, telling) in enumerate(sets):
        words = sorted(words, key=rank.get)
        full.append((t, label, words, len(words), need, span, telling))
        postings += [(w, t, i) for i, w in enumerate(words[: len(words) - need + 1])]
    index = spark.createDataFrame(postings, "word string, template int, place int").join(
        spark.createDataFrame(full, "template int, label string, template_words array<string>, size int, need int, span int, telling array<string>"), "template")
    rare = sorted({p[0] for p in postings})

    def around(e: Column, i: Column) -> Column:
        first = F.greatest(i - (reach - 1), F.lit(0))
        return F.when(e["w"].isin(*rare), F.struct(e["at"].alias("at"), e["w"].alias("word"), F.slice("known", first + 1, i - first + reach).alias("near")))

    anchors = known.select("_row", "doc_id", F.explode(F.filter(F.transform("known", around), lambda x: x.isNotNull())).alias("x")).select("_row", "doc_id", "x.*")
    # The index has as many rows as the templates have words, so broadcasting it is bounded by a parameter.
    found = anchors.join(F.broadcast(index), "word")
    found = found.withColumn("near", F.filter("near", lambda e: (e["at"] > F.col("at") - F.col("span")) & (e["at"] < F.col("at") + F.col("span"))))
    found = found.withColumn("_y", F.array_intersect(F.array(*map(F.lit, order)), F.transform("near", lambda e: e["w"])))
    left = F.size("_y") - F.array_position("_y", F.col("word"))  # words of the block behind this one in the order
    found = found.where((F.size("_y") >= F.col("need")) & (left + 1 >= F.col("need")) & (1 + F.least(F.col("size") - F.col("place") - 1, left) >= F.col("need")))  # length, prefix, place
    found = found.withColumn("near", F.filter("near", lambda e: F.array_contains("template_words", e["w"])))
    found = found.where(F.size(F.array_intersect("template_words", "_y")) >= F.col("need")).where(F.size(F.array_except("telling", "_y")) == 0)

    def block(e: Column) -> Column:
        held = F.array_distinct(F.transform(F.filter("near", lambda x: (x["at"] >= e["at"]) & (x["at"] < e["at"] + F.col("span"))), lambda x: x["w"]))
        return let(held, lambda h: F.when((F.size(h) >= F.col("need")) & (F.size(F.array_except("telling", h)) == 0), F.struct(F.size(h).alias("n"), (-e["at"]).alias("back"))))

    exact = found.withColumn("_best", F.array_max(F.filter(F.transform(F.filter("near", lambda e: e["at"] <= F.col("at")), block), lambda x: x.isNotNull()))).where("_best is not null")
    best = exact.groupBy("_row", "template").agg(F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.first("size").alias("size"), F.max("_best").alias("_best"))
    return best.select("_row", "doc_id", "template", "label", (-F.col("_best.back")).cast("long").alias("start"), (F.col("_best.n") / F.col("size")).alias("containment"))


def with_places(known: DataFrame, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """known with n_base, first_word, last_word and the base labels in `_base`."""
    placed = known.withColumn("_p", F.array(*(phrase_places(F.col("known"), p) for p in phrases)))
    places = F.flatten("_p")
    labels = F.filter(F.array(*(F.when(F.size(F.get("_p", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(phrases.values()))), lambda x: x.isNotNull())
    return placed.withColumns({"n_base": F.size(places).cast("long"), "first_word": F.array_min(places).cast("long"), "last_word": F.array_max(places).cast("long"), "_base": F.array_distinct(labels)}).drop("known", "_p")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """A row for each of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 where a base phrase stands, else the greatest containment of a matched template, else 0.
    """
    sets = template_sets(templates, threshold)
    known = known_words(own_names(docs, "doc_id", "text"), sets, phrases)
    of_row = matches(known, sets).groupBy("_row").agg(F.collect_set("label").alias("_found"), F.max("containment").alias("_most"))  # at most a label a template
    joined = with_places(known, phrases).join(of_row, "_row", "left")
    labels = F.array_sort(F.array_union(F.col("_base"), F.coalesce(F.col("_found"), F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.round("_most", 6), F.lit(0.0))).alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """All blocks that begin at a known word, counted out; no filters."""
    sets = template_sets()
    values = ", ".join(f"({t}, '{label}', {words!r}, {need}, {span}, {telling!r})" for t, (label, words, need, span, telling) in enumerate(sets))
    vocab = sorted({w for s in sets for w in s[1]})
    base = "\nUNION ALL\n".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM pos WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        for phrase, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{LICENSE_WORD}') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, 'license') OR list_contains(ws, 'cc')),
base AS ({base}),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
tpl(t, label, words, need, span, telling) AS (VALUES {values}),
k AS (SELECT doc_id, i AS at_, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) WHERE ws[i] IN ({", ".join(repr(v) for v in vocab)})),
kt AS (SELECT doc_id, t, at_, w FROM k, tpl WHERE list_contains(words, w)),
blocks AS (SELECT a.doc_id, a.t, a.at_, list(DISTINCT o.w) AS held FROM kt a JOIN kt o ON a.doc_id = o.doc_id AND a.t = o.t JOIN tpl ON tpl.t = a.t WHERE o.at_ >= a.at_ AND o.at_ < a.at_ + span GROUP BY ALL),
hit AS (SELECT doc_id, label, len(held) / len(words) AS share FROM blocks JOIN tpl USING (t) WHERE len(held) >= need AND list_has_all(held, telling)),
m AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS most FROM hit GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(b.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(round(most, 6), 0.0) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


OP1_SQL = _sql()
