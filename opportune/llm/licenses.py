"""License scans by diagonal voting, in DataFrame operations only.

All K-word grams of a document are joined, by their hashes, to the gram positions of license templates; words are compared in
the join's condition, so equal hashes of other words don't vote. A gram at word p of the document and word q of the template
votes for diagonal p - q. A phrase of BASE stands wherever its diagonal has all its grams. Notices of TEMPLATES may be edited:
diagonals no further apart than GAP are merged to a span, and a span is verified if enough of the template's grams are in it
and it is not much longer than the template.

The templates are a fixed, small set, and their grams are broadcast. A document's grams never leave its task; only votes, and
one row for each document, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 3
GAP = 6
COVERAGE = 0.6
STRETCH = 1.5

# Phrases that count wherever their words stand consecutively.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]

# The opening words of well-known license notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def template_grams(spark: SparkSession, base=BASE, templates=TEMPLATES) -> DataFrame:
    """(template, label, is_base, grams, words, off, t0, t1, t2): a row for each K-gram position of each template."""
    rows = [(i, label, i < len(base), len(text.split()) - K + 1, len(text.split()), text.split()) for i, (label, text) in enumerate([*base, *templates])]
    if any(r[3] < 1 for r in rows):
        raise ValueError(f"a template has fewer than {K} words")
    df = spark.createDataFrame(rows, "template int, label string, is_base boolean, grams int, n_template int, w array<string>")
    df = df.select("template", "label", "is_base", "grams", "n_template", "w", F.explode(F.sequence(F.lit(0), F.col("grams") - 1)).alias("off"))
    return df.select("template", "label", "is_base", "grams", "n_template", "off", *[F.col("w")[F.col("off") + k].alias(f"t{k}") for k in range(K)])


def votes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """A row for each vote, and at least one for each row of df: (row, id, n_words, pos, template columns or null)."""
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower())
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.regexp_extract_all(lower, F.lit(WORD), 1).alias("words"))
    n = F.size("words")
    shifts = docs.select("row", "id", n.cast("bigint").alias("n_words"), *[F.slice("words", k + 1, F.greatest(n, F.lit(1))).alias(f"w{k}") for k in range(K)])
    grams = shifts.select("row", "id", "n_words", F.posexplode_outer(F.arrays_zip(*[f"w{k}" for k in range(K)])).alias("pos", "gram"))
    grams = grams.select("row", "id", "n_words", "pos", *[F.col(f"gram.w{k}") for k in range(K)])
    known = template_grams(df.sparkSession, base, templates).withColumn("hash", F.xxhash64(*[f"t{k}" for k in range(K)]))
    hit = (F.xxhash64(*[f"w{k}" for k in range(K)]) == F.col("hash")) & F.expr(" and ".join(f"w{k} = t{k}" for k in range(K)))
    out = grams.join(F.broadcast(known), hit, "left").where("template is not null or pos is null or pos = 0")
    return out.select("row", "id", "n_words", "pos", "template", "label", "is_base", "grams", "n_template", "off")


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """Spans of each row of df: (row, id, n_words, label, is_base, first, last, coverage, verified), words counted from 0.

    A row without any gram of a template has one row with a null label. Null text counts as empty. Repeated rows and null ids are
    rows of their own; an empty table gives no rows; other columns are ignored.
    """
    cast = votes(df, id_col, text_col, base, templates).repartition("row")  # a document's votes together, for all that follows
    key = ["row", "id", "n_words", "template", "label", "is_base", "grams", "n_template"]
    diagonals = cast.withColumn("diagonal", F.col("pos") - F.col("off")).groupBy(*key, "diagonal")
    diagonals = diagonals.agg(F.collect_set("off").alias("offs"), F.min("pos").alias("lo"), (F.max("pos") + K - 1).alias("hi"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order)
    joined = diagonals.withColumn("new", F.when(F.col("is_base") | (apart > GAP), 1).otherwise(0))
    joined = joined.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = joined.groupBy(*key, "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("offs")))).alias("found"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    coverage = F.col("found") / F.col("grams")
    fits = F.col("last") - F.col("first") + 1 <= F.col("n_template") * STRETCH
    verified = F.when(F.col("is_base"), coverage == 1).otherwise((coverage >= COVERAGE) & fits)
    return merged.select("row", "id", "n_words", "label", "is_base", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), coverage.alias("coverage"), verified.alias("verified"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row for each row of df: (id_col, n_words, n_base, first_word, last_word, base_labels, labels, score).

    score is the largest coverage of a verified span (1 for a base phrase), 0 without one. See `spans` for odd rows.
    """
    found = spans(df, id_col, text_col, base, templates)
    base_hit, hit = F.col("is_base") & F.col("verified"), F.coalesce(F.col("verified"), F.lit(False))
    listed = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")
    out = found.groupBy("row", "id", "n_words").agg(
        F.count(F.when(base_hit, 1)).alias("n_base"),
        F.min(F.when(base_hit, F.col("first"))).alias("first_word"),
        F.max(F.when(base_hit, F.col("first"))).alias("last_word"),
        listed(base_hit).alias("base_labels"),
        listed(hit).alias("labels"),
        F.coalesce(F.max(F.when(hit, F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return out.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def duckdb_sql(base=BASE, templates=TEMPLATES) -> str:
    """The same scan of `documents` in DuckDB's SQL."""
    rows = ", ".join(f"({i}, '{label}', {i < len(base)}, '{text}')" for i, (label, text) in enumerate([*base, *templates]))
    return rf"""
WITH t AS (SELECT template, label, is_base, string_split(txt, ' ') AS w FROM (VALUES {rows}) AS v(template, label, is_base, txt)),
tg AS (SELECT template, label, is_base, len(w) - {K - 1} AS grams, len(w) AS n_template, off, w[off+1] || ' ' || w[off+2] || ' ' || w[off+3] AS gram
       FROM t, unnest(range(len(w) - {K - 1})) AS u(off)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dg AS (SELECT rid, pos, w[pos+1] || ' ' || w[pos+2] || ' ' || w[pos+3] AS gram FROM d, unnest(range(greatest(len(w) - {K - 1}, 0))) AS u(pos)),
g AS (SELECT rid, template, label, is_base, grams, n_template, pos - off AS diagonal, list(DISTINCT off) AS offs, min(pos) AS lo, max(pos) + {K - 1} AS hi
      FROM dg JOIN tg USING (gram) GROUP BY ALL),
n AS (SELECT *, CASE WHEN is_base OR diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS fresh FROM g),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS part FROM n),
m AS (SELECT rid, template, label, is_base, grams, n_template, part, len(list_distinct(flatten(list(offs)))) AS found, min(lo) AS first, max(hi) AS last FROM p GROUP BY ALL),
s AS (SELECT rid, label, is_base, first, found / grams AS coverage,
      CASE WHEN is_base THEN found = grams ELSE found / grams >= {COVERAGE} AND last - first + 1 <= n_template * {STRETCH} END AS verified FROM m)
SELECT d.doc_id, len(any_value(d.w))::BIGINT AS n_words, count(*) FILTER (is_base AND verified) AS n_base,
       min(first) FILTER (is_base AND verified) AS first_word, max(first) FILTER (is_base AND verified) AS last_word,
       coalesce(list_aggregate(list_sort(list(DISTINCT label) FILTER (is_base AND verified)), 'string_agg', ','), '') AS base_labels,
       coalesce(list_aggregate(list_sort(list(DISTINCT label) FILTER (verified)), 'string_agg', ','), '') AS labels,
       coalesce(max(coverage) FILTER (verified), 0.0)::DOUBLE AS score
FROM d LEFT JOIN s USING (rid) GROUP BY rid, d.doc_id"""
