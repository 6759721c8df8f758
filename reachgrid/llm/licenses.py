"""License scans by diagonal voting, in DataFrame functions only.

Every document's words become rolling two-word hashes, which are joined to the
hashes of the license templates (a fixed table of a few hundred rows, broadcast).
A match at word ``p`` of a document and word ``t`` of a template votes for the
diagonal ``p - t``; votes are gathered per document, template and diagonal as a bit
mask, so that repeats count once. Phrases need every vote of one diagonal. For
longer templates neighbouring diagonals, which differ by the words that an edit
put in or left out, are merged; a merged span is verified by the share of the
template's votes it holds and by its length against the template's.

Defined results: a null or empty text has no words, no places and score 0;
repeated rows each give their row; of equal shares any stands for the score; long texts
are scanned whole; columns other than the key and text are not read, whatever their names;
an empty table gives no rows. Only A to Z are lower-cased in effect: see ``_folded``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.shared import written
from reachgrid.llm.common import documents, text_or_empty

#: A word of lower-cased text: ASCII digits and letters, and all that is not ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of which each place counts, by label.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Sentences of public licenses, by label; at most 60 words each.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "released under the bsd license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

MIN_SHARE = 0.75
MAX_SHIFT = 3


def templates(spark: SparkSession) -> DataFrame:
    """_hash, template, label, phrase, at, votes: a row per two-word hash of the fixed templates."""
    rows = [(label, text, True) for label, text in sorted(PHRASES.items())] + [(label, text, False) for label, text in TEMPLATES]
    table = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "template int, label string, text string, phrase boolean")
    table = table.withColumn("_words", F.split("text", " "))
    grams = F.expr("transform(slice(_words, 1, size(_words) - 1), (w, i) -> xxhash64(w, _words[i + 1]))")
    return table.select("template", "label", "phrase", (F.size("_words") - 1).alias("votes"), F.posexplode(grams).alias("at", "_hash"))


def _folded(text: Column) -> Column:
    """``text`` with A to Z lower-cased, as far as templates can tell.

    ``lower`` also folds other letters, but the templates are ASCII, and the Kelvin sign is the only letter
    outside ASCII whose lower case is ASCII alone; another letter, which no template has, stands in for it.
    """
    return F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u212b")))


def diagonals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row key, template and diagonal: mask of template places voted for, first and last word.

    Each row of ``docs`` also gives rows without a template; their ``rows`` add up
    to the number of equal rows.
    """
    words = F.regexp_extract_all(_folded(text_or_empty()), F.lit(LICENSE_WORD), F.lit(0))
    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_or_empty()).alias("_text"), words.alias("_words"))
    # The first element stands for the document itself and matches nothing.
    grams = F.expr("concat(array(cast(null as long)), transform(slice(_words, 1, greatest(size(_words) - 1, 0)), (w, i) -> xxhash64(w, get(_words, i + 1))))")
    d = d.select("doc_id", "_text", F.size("_words").cast("long").alias("n_words"), grams.alias("_grams"))
    d = d.select("doc_id", "_text", "n_words", F.posexplode_outer("_grams").alias("_at", "_hash"))
    d = d.join(F.broadcast(templates(docs.sparkSession)), "_hash", "left")
    d = d.where(F.col("template").isNotNull() | (F.col("_at") == 0))
    vote = F.expr("case when template is not null then shiftleft(1L, at) end")
    place = F.when(F.col("template").isNotNull(), F.col("_at") - 1)
    return d.groupBy("doc_id", "_text", "n_words", "template", "label", "phrase", "votes", (place - F.col("at")).alias("diagonal")).agg(
        F.bit_or(vote).alias("mask"), F.min(place).alias("first"), (F.max(place) + 1).alias("last"), F.count("*").alias("rows")
    )


def spans(found: DataFrame, min_share: float = MIN_SHARE, max_shift: int = MAX_SHIFT) -> DataFrame:
    """Verified spans of ``diagonals``: doc_id, label, phrase, first and last word, share of votes."""
    keys = ["doc_id", "_text", "n_words", "template", "label", "phrase", "votes"]
    hits = found.where(F.col("template").isNotNull())
    order = Window.partitionBy(*keys).orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    # Phrases are never merged: each diagonal is a place of its own.
    new = F.when(F.col("phrase") | gap.isNull() | (gap > max_shift), 1).otherwise(0)
    merged = hits.withColumn("_new", new).withColumn("_group", F.sum("_new").over(order))
    merged = merged.groupBy(*keys, "_group").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.bit_count("mask") / F.col("votes")
    fits = F.col("last") - F.col("first") + 1 <= 2 * (F.col("votes") + 1)
    return merged.withColumn("share", share).where(F.when(F.col("phrase"), share == 1).otherwise((share >= min_share) & fits)).drop("_group", "mask")


def license_scan(docs: DataFrame, key: str = "doc_id", min_share: float = MIN_SHARE, max_shift: int = MAX_SHIFT) -> DataFrame:
    """One row per document: words, places of the phrases, labels and the best share of a template."""
    found = written(diagonals(docs, key), "diagonals")
    verified = spans(found, min_share, max_shift).select("doc_id", "_text", "n_words", "label", "phrase", "first", "share", F.lit(0).cast("long").alias("rows"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("label", "string"), ("phrase", "boolean"), ("first", "int"), ("share", "double"))]
    every = found.where(F.col("template").isNull()).select("doc_id", "_text", "n_words", *nothing, "rows")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    rows = every.unionByName(verified).groupBy("doc_id", "_text", "n_words").agg(
        F.count_if("phrase").alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sum("rows").cast("int").alias("_rows"),
    )
    rows = rows.withColumn("_each", F.explode(F.sequence(F.lit(1), "_rows")))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _template_values() -> str:
    rows = [(label, text, True) for label, text in sorted(PHRASES.items())] + [(label, text, False) for label, text in TEMPLATES]
    return ", ".join(f"({i}, '{label}', '{text}', {phrase})" for i, (label, text, phrase) in enumerate(rows))


ORACLE_SQL = rf"""
WITH t AS (
  SELECT template, label, string_split(text, ' ') AS ws, phrase
  FROM (VALUES {_template_values()}) v(template, label, text, phrase)),
g AS (SELECT template, label, phrase, len(ws) - 1 AS votes, i - 1 AS tpos, ws[i] AS a, ws[i + 1] AS b
      FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LICENSE_WORD}') AS ws FROM documents),
w AS (SELECT rid, i - 1 AS p, ws[i] AS a, ws[i + 1] AS b FROM (SELECT *, unnest(range(1, len(ws))) AS i FROM d)),
v AS (
  SELECT rid, template, label, phrase, votes, p - tpos AS diagonal, bit_or(1::BIGINT << tpos) AS mask, min(p) AS first, max(p) + 1 AS last
  FROM w JOIN g USING (a, b) GROUP BY ALL),
n AS (SELECT *, CASE WHEN phrase OR lag(diagonal) OVER o IS NULL OR diagonal - lag(diagonal) OVER o > {MAX_SHIFT} THEN 1 ELSE 0 END AS new
      FROM v WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
k AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS grp FROM n),
m AS (
  SELECT rid, template, label, phrase, grp, bit_count(bit_or(mask)) / votes AS share, min(first) AS first, max(last) AS last, votes
  FROM k GROUP BY rid, template, label, phrase, votes, grp),
s AS (SELECT * FROM m WHERE CASE WHEN phrase THEN share = 1 ELSE share >= {MIN_SHARE} AND last - first + 1 <= 2 * (votes + 1) END)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words, count(*) FILTER (phrase) AS n_base,
       CAST(min(first) FILTER (phrase) AS BIGINT) AS first_word, CAST(max(first) FILTER (phrase) AS BIGINT) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, round(coalesce(max(share), 0), 6) AS score
FROM d LEFT JOIN s USING (rid) GROUP BY rid
"""
