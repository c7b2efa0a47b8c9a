"""Passages: chunking, BM25, budgets. C1.

Chunking is row by row: lines, running sums and islands are folds over one document's array, so
that no line of a document is ever shuffled. Ranking explodes only query terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions.text import lines, strip, tokens

K1, B = 1.5, 0.75


def chunk_table(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, pos, heading, offset, text).

    A row a line, windows by document. Lines of one document meet in one task; documents are
    what a reader reads, so that is bounded by the longest one.
    """
    raw = docs.select(key, F.posexplode(lines(F.coalesce(F.col(markdown), F.lit("")))).alias("i", "raw"))
    order = Window.partitionBy(key).orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = F.regexp_replace("raw", r"\n+$", "")
    marked = raw.select(
        key,
        "i",
        line.alias("line"),
        F.coalesce(F.sum(F.length("raw")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("offset"),
        (strip(line) == "").alias("blank"),
        line.rlike(P.HEAD).alias("head"),
    )
    heading = F.when(F.col("head") & ~F.col("blank"), F.left(strip(F.regexp_replace("line", P.HEAD, "")), F.lit(P.HEADING)))
    stops = F.col("blank") | F.col("head")
    islands = marked.select(
        key, "i", "line", "offset", F.last(heading, ignorenulls=True).over(upto).alias("heading"), stops.alias("stops"), F.sum(F.when(stops, 1).otherwise(0)).over(upto).alias("island")
    ).where("NOT stops")
    grouped = islands.groupBy(key, "island").agg(
        F.min("offset").alias("offset"), F.first("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("offset")) - 1
    return grouped.select(key, pos.cast("int").alias("pos"), "heading", "offset", text.alias("text"))


def query_terms(query: str) -> list[str]:
    import re

    return re.findall("[a-z0-9]+", query.lower())


def _term_counts(words: Column, terms: list[str]) -> Column:
    def times(term: str) -> Column:
        return F.size(F.filter(words, lambda w: w == term))

    return F.array(*[times(t) for t in terms]) if terms else F.array().cast("array<int>")


def idf(n: Column, df: Column) -> Column:
    """H8."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(chunks: DataFrame, query: str, pool: list[str] | None = None, text: str = "text") -> DataFrame:
    """Chunks with `score`. The pool that df and the average length come from is the whole
    table, or each group of the `pool` columns.

    A chunk becomes the counts of the query's terms and its length in the scan; the pool's
    statistics are a handful of numbers, aggregated in the tasks first.
    """
    terms = list(dict.fromkeys(query_terms(query)))
    rows = chunks.withColumn("__words", tokens(F.col(text)))
    rows = rows.withColumn("__tf", _term_counts(F.col("__words"), terms)).withColumn("__len", F.size("__words")).drop("__words")
    stats = [F.count(F.lit(1)).alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col("__tf")[i] > 0).alias(f"__df{i}") for i in range(len(terms))]]
    if pool:
        rows = rows.join(rows.groupBy(*pool).agg(*stats), pool)
    else:
        one = rows.agg(*stats)
        # One row: the statistics of the whole table.
        rows = rows.join(F.broadcast(one))
    mean = F.coalesce(F.nullif(F.col("__avg"), F.lit(0.0)), F.lit(1.0))
    score = F.lit(0.0)
    for term in query_terms(query):  # the multiset: a repeated term counts again
        i = terms.index(term)
        f = F.col("__tf")[i]
        gain = idf(F.col("__n"), F.col(f"__df{i}")) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("__len") / mean))
        score = score + F.when(f > 0, gain).otherwise(0.0)
    return rows.withColumn("score", score).drop("__tf", "__len", "__n", "__avg", *[f"__df{i}" for i in range(len(terms))])


def admitted(scored: DataFrame, max_tokens: int, by: list[str], order: list[Column], text: str = "text") -> DataFrame:
    """The best chunks within the budget, the first one always; with rank and truncated.

    by: the groups that have a budget of their own. Only chunks with a score reach the window. Under
    one budget for all, only the best of them do: an admitted chunk costs three characters or more,
    so that a third of the budget bounds their number, and one more that doesn't fit tells `truncated`.
    """
    hits = scored.where(F.col("score") > 0)
    if not by:
        hits = hits.orderBy(F.desc("score"), *order).limit(max_tokens * P.CHARS_PER_TOKEN // 3 + 2)
    best = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(F.desc("score"), *order)
    cost = F.sum(F.length(text) + 2).over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = hits.withColumn("rank", F.row_number().over(best)).withColumn("__used", cost)
    fits = (F.col("__used") <= max_tokens * P.CHARS_PER_TOKEN) | (F.col("rank") == 1)
    every = Window.partitionBy(*by) if by else Window.partitionBy()
    rows = rows.withColumn("__fits", fits).withColumn("truncated", F.bool_or(~fits).over(every))
    return rows.where("__fits").drop("__used", "__fits")


def in_reading_order(kept: DataFrame, key: str) -> DataFrame:
    """(key, body, matches, truncated), chunks by offset."""
    one = F.struct("offset", F.col("heading").alias("heading"), F.round("score", 4).alias("score"), "text")
    listed = kept.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("c"), F.bool_or("truncated").alias("truncated"))
    body = F.array_join(F.transform("c", lambda x: x["text"]), "\n\n")
    matches = F.transform("c", lambda x: F.struct(x["heading"].alias("heading"), x["offset"].alias("offset"), x["score"].alias("score")))
    return listed.select(key, body.alias("body"), matches.alias("matches"), "truncated")
