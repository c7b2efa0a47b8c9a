"""Provenance receipts: C5. Hash, words, author, dates, canonical address, language."""

from __future__ import annotations

from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions.text import clean_field, plausible_author, strip, word_count
from veritext.functions.urls import safe_url


def lower_keys(meta: Column) -> Column:
    """Keys in lower case; of keys that meet, the last wins, without the session's key policy."""
    entries = F.map_entries(meta)
    low = F.transform(entries, lambda e, i: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"), i.alias("i")))
    last = F.filter(low, lambda e: ~F.exists(low, lambda o: (o["key"] == e["key"]) & (o["i"] > e["i"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def first_of(meta: Column, keys: tuple[str, ...]) -> Column:
    """The first non-empty value."""
    return F.coalesce(*[F.nullif(F.try_element_at(meta, F.lit(k)), F.lit("")) for k in keys])


def receipt(markdown: Column, author: Column, published: Column, canonical: Column, meta: Column, page_canonical: Column, language: Column) -> Column:
    """Struct of the receipt; extractor first, then the page's metadata."""
    raw = lower_keys(meta)
    return F.struct(
        F.sha2(markdown, 256).alias("content_hash"),
        word_count(markdown).alias("word_count"),
        clean_field(F.coalesce(plausible_author(author), first_of(raw, P.AUTHOR_KEYS)), P.META).alias("author"),
        clean_field(F.coalesce(F.nullif(published, F.lit("")), first_of(raw, P.PUBLISHED_KEYS)), P.PUBLISHED).alias("published"),
        clean_field(first_of(raw, P.MODIFIED_KEYS), P.META).alias("modified"),
        F.coalesce(safe_url(canonical), page_canonical, safe_url(first_of(raw, ("canonical",)))).alias("canonical"),
        language.alias("language"),
    )


class LanguageModel:
    """Naive Bayes over character trigrams; tables of `most` trigrams a language."""

    def __init__(self, tables: dict[str, dict[str, float]], floor: float):
        self.tables, self.floor = tables, floor

    @staticmethod
    def grams(text: str) -> list[str]:
        t = " " + " ".join(text.lower().split()) + " "
        return [t[i : i + 3] for i in range(len(t) - 2)]

    def classify(self, text: str) -> str:
        grams = self.grams(text)
        return max(sorted(self.tables), key=lambda k: sum(self.tables[k].get(g, self.floor) for g in grams))


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = 400, most: int = 2_000) -> LanguageModel:
    """A model of a bounded sample: at most `sample` texts a language, those with the smallest hash."""
    from pyspark.sql import Window

    order = Window.partitionBy(lang).orderBy(F.xxhash64(text))
    rows = docs.select(lang, F.left(text, F.lit(2000)).alias(text)).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    got = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).collect()
    counts: dict[str, Counter] = {}
    for r in got:
        counts.setdefault(r[lang], Counter()).update(LanguageModel.grams(r[text]))
    tables = {}
    for k, c in counts.items():
        total = sum(c.values())
        tables[k] = {g: log(n / total) for g, n in c.most_common(most)}
    return LanguageModel(tables, log(1e-6))


def detect_language(text: Column, hint: Column, model: LanguageModel) -> Column:
    """The language of the first 2000 characters; the hint for texts of less than 20."""

    @F.arrow_udf("string")
    def classify(column: pa.Array) -> pa.Array:
        return pa.array([model.classify(t) if t else None for t in column.to_pylist()], pa.string())

    sample = strip(F.coalesce(text, F.lit("")))
    long = F.length(sample) >= 20
    return F.when(long, classify(F.when(long, F.left(sample, F.lit(2000))))).otherwise(F.nullif(hint, F.lit("")))
