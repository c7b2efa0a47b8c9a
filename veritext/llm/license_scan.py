"""License scan by diagonal voting over word k-grams.

1. Each document's rolling hashes of `k` words (A-Z in lower case, runs of digits, letters and
   bytes beyond ASCII) are joined by Spark to the positions of the same hashes in the templates.
   The template side has a few hundred rows, fixed by this file, and is broadcast.
2. Hits are counted by (document, template, diagonal), a diagonal being the place in the document
   less the place in the template. Only hits are shuffled.
3. Base phrases: a diagonal with a vote of every gram is a place where the phrase stands.
4. Other templates: diagonals that lie within `gap` of each other are merged, which bridges
   left-out and inserted words. If that gives more than twice the template's words, as a row of
   stray grams does, only those diagonals with two votes or more are merged there. A merged span
   needs two votes, or every gram.
5. A merged span is accepted if it holds at least `share` of the template's grams and isn't
   more than twice as long as the template.


Hashes are not trusted: where a text is read, a gram with a template gram's hash is compared with it
word by word, and gets another hash if it differs. Long texts are handled as a whole; ties between
templates don't arise, as each counts for itself.

The score is the largest share of a template's grams that one span holds (1 for base phrases), 0
without a span. Null and empty texts have no words, no places and score 0. Repeated rows are
scanned one by one. Rows are told apart by a row number, not by doc_id. Other columns are
ignored, empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm import _bytes as B
from veritext.llm._shared import chunks, short_batches, text_buffer

#: The phrases whose places are counted, with their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Opening words of public license notices.
TEMPLATES = (
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("artistic", "the artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsl", "boost software license version 1 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("epl", "eclipse public license v 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def grams_of(buf: np.ndarray, offs: np.ndarray, k: int, known: dict[int, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the number of the first word of each row.

    known: the words behind hashes that mean something; runs of other words don't get these.
    """
    low = B.LOWER[buf]
    start, end, first = B.words(low, offs, B.PLAIN)
    g = B.grams(B.span_hash(B.prefix(low), start, end), k)
    if known:
        sieve = np.zeros(1 << 16, bool)
        sieve[[h & 0xFFFF for h in known]] = True
        for i in np.flatnonzero(sieve[(g & np.uint64(0xFFFF)).astype(np.int64)]).tolist():
            words = known.get(int(g[i]))
            if words is not None and b" ".join(low[a:z].tobytes() for a, z in zip(start[i : i + k], end[i : i + k])) != words:
                g[i] = 1
    return g, first


def _grams(text: str, k: int) -> list[tuple[int, bytes]]:
    """Hash and words of each run of a template."""
    buf = np.frombuffer(text.encode(), np.uint8)
    words = text.encode().split()
    return [(h, b" ".join(words[i : i + k])) for i, h in enumerate(grams_of(buf, np.array([0, len(buf)]), k)[0].tolist())]


def template_grams(spark: SparkSession, base: tuple, templates: tuple, k: int) -> DataFrame:
    rows, marker = [], (0, -1, 0, 1, True, "")
    for number, (label, text, is_base) in enumerate([*((a, b, True) for a, b in base), *((a, b, False) for a, b in templates)]):
        codes = [h - (1 << 64) if h >> 63 else h for h, _ in _grams(text, k)]
        if not codes:
            raise ValueError(f"template {text!r} has fewer than {k} words")
        rows += [(h, number, i, len(codes), is_base, label) for i, h in enumerate(codes)]
    return spark.createDataFrame([marker, *rows], "gram bigint, template int, place int, grams int, is_base boolean, label string")


def document_grams(docs: DataFrame, k: int, text_column: str, known: dict[int, bytes]) -> DataFrame:
    """docs with n_words and all rolling hashes; the first entry, 0, stands for the document."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("struct<n_words:bigint,grams:array<bigint>>")
    def rolled(text: pa.Array) -> pa.Array:
        buf, offs = text_buffer(text)
        counts, lists = [], []
        for lo, hi in chunks(offs):
            g, first = grams_of(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k, known)
            g[g == 0] = 1
            ok = B.within(first, k)
            n = np.diff(first)
            size = np.maximum(n - (k - 1), 0) + 1
            ends = np.cumsum(size)
            flat = np.zeros(int(ends[-1]), np.int64)
            body = np.ones(len(flat), bool)
            body[ends - size] = False
            flat[body] = g[ok].view(np.int64)
            counts.append(n)
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat)))
        if not lists:
            return pa.array([], pa.struct([("n_words", pa.int64()), ("grams", pa.list_(pa.int64()))]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts), pa.int64()), pa.concat_arrays(lists)], names=["n_words", "grams"])

    return docs.withColumn("rolled", rolled(F.col(text_column)))


def scan_licenses(
    docs: DataFrame,
    base: tuple = BASE,
    templates: tuple = TEMPLATES,
    k: int = 2,
    gap: int = 3,
    share: float = 0.75,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: accepted spans as struct(label, from_word, to_word, share), in order.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_column).alias("text"))
    known = {h: words for _, text in (*base, *templates) for h, words in _grams(text, k)}
    rows = document_grams(rows, k, "text", known).select("doc_id", "row", "rolled.n_words", F.posexplode("rolled.grams").alias("at", "gram"))
    hits = rows.join(F.broadcast(template_grams(docs.sparkSession, base, templates, k)), "gram")
    place = F.col("at") - 1
    votes = hits.groupBy("row", "doc_id", "n_words", "template", "grams", "is_base", "label", (place - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("places"), F.min(place).alias("from_word"), (F.max(place) + k).alias("to_word")
    )
    whole = F.size("places") == F.col("grams")
    votes = votes.where((F.col("template") < 0) | ~F.col("is_base") | whole)
    # Neighbouring diagonals of one template in one document.
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("is_base") | (F.col("diagonal") - F.lag("diagonal").over(line) > gap)
    number = F.sum(F.when(F.col("apart"), 1).otherwise(0)).over(line)
    votes = votes.withColumn("apart", apart).withColumn("island", number)
    island = Window.partitionBy("row", "template", "island")
    size = F.max("to_word").over(island) - F.min("from_word").over(island)
    votes = votes.withColumn("fits", size <= 2 * (F.col("grams") + k - 1))
    votes = votes.where((F.col("template") < 0) | F.col("is_base") | F.col("fits") | (F.size("places") >= 2) | whole)
    votes = votes.withColumn("apart", apart).withColumn("island", number)
    spans = votes.groupBy("row", "doc_id", "n_words", "template", "grams", "is_base", "label", "island").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("held"), F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word")
    )
    spans = spans.where((F.col("template") < 0) | (F.col("held") >= 2) | (F.col("held") == F.col("grams")))
    spans = spans.withColumn("share", F.least(F.lit(1.0), F.col("held") / F.col("grams")))
    found = (F.col("template") >= 0) & (F.col("is_base") | ((F.col("share") >= share) & (F.col("to_word") - F.col("from_word") <= 2 * (F.col("grams") + k - 1))))
    is_place = found & F.col("is_base")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if(is_place).alias("n_base"),
            F.min(F.when(is_place, F.col("from_word"))).cast("long").alias("first_word"),
            F.max(F.when(is_place, F.col("from_word"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(is_place, F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(found, F.col("label")))), ",").alias("labels"),
            F.max(F.when(F.col("template") >= 0, F.col("share")).otherwise(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(found, F.struct("from_word", "to_word", "label", "share")))).alias("spans"),
        )
        .drop("row")
    )


def scan_sql(base: tuple = BASE, templates: tuple = TEMPLATES, gap: int = 3, share: float = 0.75) -> str:
    """The same scan (k = 2) over documents for DuckDB."""
    rows = ", ".join(f"({i}, '{label}', '{text}', {str(b).lower()})" for i, (label, text, b) in enumerate([*((x, y, True) for x, y in base), *((x, y, False) for x, y in templates)]))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT tid, label, base, string_split(phrase, ' ') AS ws FROM (VALUES {rows}) v(tid, label, phrase, base)),
tg AS (SELECT tid, label, base, len(ws) - 1 AS grams, j, ws[j + 1] || ' ' || ws[j + 2] AS g FROM t, unnest(range(len(ws) - 1)) u(j)),
dg AS (SELECT doc_id, i, ws[i + 1] || ' ' || ws[i + 2] AS g FROM d, unnest(range(len(ws) - 1)) u(i)),
hits AS (SELECT doc_id, tid, label, base, grams, i, j, i - j AS diagonal FROM dg JOIN tg USING (g)),
v0 AS (SELECT doc_id, tid, label, base, grams, diagonal, count(DISTINCT j) AS nj, min(i) AS lo, max(i) + 2 AS hi FROM hits GROUP BY ALL),
places AS (SELECT * FROM v0 WHERE base AND nj = grams),
v1 AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > {gap}, true)::INT AS apart FROM v0 WHERE NOT base),
v2 AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM v1),
v3 AS (SELECT * FROM (SELECT *, max(hi) OVER w - min(lo) OVER w AS size FROM v2 WINDOW w AS (PARTITION BY doc_id, tid, island)) WHERE size <= 2 * (grams + 1) OR nj >= 2 OR nj = grams),
v4 AS (SELECT * EXCLUDE (apart, island), coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) > {gap}, true)::INT AS apart FROM v3),
v5 AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM v4),
held AS (SELECT v5.doc_id, v5.tid, v5.label, v5.grams, v5.island, count(DISTINCT j) AS held, min(lo) AS lo, max(hi) AS hi FROM v5 JOIN hits USING (doc_id, tid, diagonal) GROUP BY ALL),
spans AS (SELECT doc_id, label, least(1.0, held / grams)::DOUBLE AS part, least(1.0, held / grams) >= {share} AND hi - lo <= 2 * (grams + 1) AS found FROM held WHERE held >= 2 OR held = grams
          UNION ALL SELECT doc_id, label, 1.0::DOUBLE, true FROM places),
b AS (SELECT doc_id, count(*) AS n_base, min(lo) AS first_word, max(lo) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found) AS labels, max(part) AS score FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
