"""License scans by diagonal voting, in DataFrame operations only.

Texts become words (ASCII letters lower-cased, split at ASCII characters that are no letters or digits). All rolling
three-word grams of a text are hashed; those whose hash a template has are joined to the template's positions, by hash
and by the words themselves. Each match votes for the diagonal text position - template position. A phrase stands where
all its grams vote for one diagonal, which is its place. For the longer notices, diagonals that lie within three of
each other are merged (words put in or left out shift the diagonal), and a merged span is a finding if its matches
cover ``least`` of the template's positions.

The templates are a fixed list, so that the broadcast has a fixed size; no text leaves its task, and what is shuffled
is one narrow row for a document and one for a match.

Defined cases: null text counts as empty; rows with null or repeated doc_id keep a row each; texts of fewer than three
words hold nothing; phrases may overlap and are all counted; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import whole

K = 3
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases whose places are counted, and their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
# Notices by which licences are stated, in the words that texts are cut to.
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("gpl-3", "gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2"),
    ("gpl", "of the gnu general public license as published by"),
    ("lgpl", "of the gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
LEAST, NEIGHBOURS = 0.8, 3


def templates(spark: SparkSession, phrases: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each gram of a template: template, label, phrase (or notice), grams of it, at, gram, hash."""
    rows = []
    for number, (label, text) in enumerate([*phrases, *notices]):
        words = text.split()
        n = len(words) - K + 1
        if n < 1:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(number, label, number < len(phrases), n, at, " ".join(words[at : at + K])) for at in range(n)]
    table = spark.createDataFrame(rows, "template int, label string, phrase boolean, grams int, at int, gram string")
    gram = F.split("gram", " ")
    return table.withColumn("hash", F.xxhash64(*(gram[i] for i in range(K))))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, and no other letters; faster for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def license_scan(
    docs: DataFrame, *, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, least: float = LEAST
) -> DataFrame:
    """A row per document and span: row, doc_id, n_words, template, label, phrase, first_word, last_word, coverage.

    A document without findings has one row with nulls. ``row`` tells documents apart.
    """
    spark = docs.sparkSession
    table = templates(spark, phrases, notices)
    hashes = [r[0] for r in table.select("hash").distinct().collect()]  # of the fixed list
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
        F.regexp_extract_all(lower_ascii(whole()), F.lit(f"({WORDS})"), F.lit(1)).alias("words"),
    )
    w = F.col("words")
    starts = F.when(F.size(w) >= K, F.sequence(F.lit(0), F.size(w) - K)).otherwise(F.array().cast("array<int>"))
    found = F.filter(starts, lambda i: F.xxhash64(*(w[i + j] for j in range(K))).isin(hashes))
    grams = F.transform(found, lambda i: F.struct(i.alias("pos"), F.concat_ws(" ", *(w[i + j] for j in range(K))).alias("gram"), F.xxhash64(*(w[i + j] for j in range(K))).alias("hash")))
    hits = words.select("row", "doc_id", F.size(w).cast("long").alias("n_words"), F.explode_outer(grams).alias("hit"))
    hits = hits.select("row", "doc_id", "n_words", "hit.pos", "hit.gram", "hit.hash")
    voted = hits.join(F.broadcast(table), ["hash", "gram"], "left").repartition("row")

    key = ["row", "doc_id", "n_words", "template", "label", "phrase", "grams"]
    diagonals = voted.withColumn("diagonal", F.col("pos") - F.col("at")).groupBy(*key, "diagonal")
    diagonals = diagonals.agg(F.collect_set("at").alias("matched"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEIGHBOURS)
    spans = diagonals.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by_diagonal))
    spans = spans.groupBy(*key, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("votes"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    coverage = F.col("votes") / F.col("grams")
    stands = F.when(F.col("phrase"), coverage == 1).otherwise(coverage >= least)
    return spans.select(
        "row", "doc_id", "n_words", "template",
        *(F.when(stands, F.col(c)).alias(n) for c, n in (("label", "label"), ("phrase", "phrase"))),
        F.when(stands, F.col("first")).cast("long").alias("first_word"), F.when(stands, F.col("last") + K - 1).cast("long").alias("last_word"),
        F.coalesce(coverage, F.lit(0.0)).alias("coverage"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.col("phrase")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"), joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"), F.max("coverage").alias("score"),
    ).drop("row")


def oracle() -> str:
    """The scan in SQL: the same templates, their grams joined to all grams of all texts."""
    rows = ", ".join(f"({i}, '{label}', {str(i < len(PHRASES)).lower()}, '{text}')" for i, (label, text) in enumerate([*PHRASES, *NOTICES]))
    return f"""
WITH t AS (SELECT *, string_split(text, ' ') AS w FROM (VALUES {rows}) AS v(template, label, phrase, text)),
g AS (SELECT template, label, phrase, len(w) - {K - 1} AS grams, i - 1 AS place, array_to_string(w[i : i + {K - 1}], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - {K - 2})) AS i FROM t)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
h AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i : i + {K - 1}], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {K - 2})) AS i FROM d)),
m AS (SELECT doc_id, pos, place, pos - place AS diagonal, template, label, phrase, grams FROM h JOIN g USING (gram)),
x AS (SELECT doc_id, template, label, phrase, grams, diagonal, min(pos) AS a, list(DISTINCT place) AS matched FROM m GROUP BY ALL),
y AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER o > {NEIGHBOURS}, true) THEN 1 ELSE 0 END AS apart FROM x WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal)),
z AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM y),
s AS (SELECT doc_id, template, label, phrase, min(a) AS a, len(list_distinct(flatten(list(matched)))) / grams AS coverage FROM z GROUP BY doc_id, template, label, phrase, grams, span),
f AS (SELECT *, CASE WHEN phrase THEN coverage = 1 ELSE coverage >= {LEAST} END AS stands FROM s)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (stands AND phrase) AS n_base, (min(a) FILTER (stands AND phrase))::BIGINT AS first_word, (max(a) FILTER (stands AND phrase))::BIGINT AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands AND phrase), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (stands), '') AS labels,
       coalesce(max(coverage), 0.0) AS score
FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


ORACLE = oracle()
