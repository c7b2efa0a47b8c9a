"""A corpus pipeline in five stages; part of the corpus operators (veritext.llm).

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns those that stay,
with the columns of documents; the last one returns the mix. Between stages the rows are
written as Parquet and read again; run() deletes what a stage has left behind. Toxicity scores have
no SQL, so the pipeline is held against loops over the rows (tests/llm), nulls, copies, repeated
rows, clashing extra columns and empty tables included.

Nulls, empty and long texts, ties, repeated rows and extra columns: as the operators' modules say. Texts
without a word of any labelled example are kept (their score is the rate of toxic labels, unless that is
0.5 or more); rows without a doc_id pass the deduplicating stages unless their text has a copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from veritext.llm._shared import discard, fresh, own, stored_alone


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the nearest labelled examples call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = toxicity.fit(docs, labels, learnable=F.crc32(F.col("id").cast("string")) % 5 != 0)
    (found,) = fresh(docs, "toxicity")
    scored = toxicity.with_toxicity(docs, index, out=found)
    return scored.where(F.col(found)["score"] < 0.5).select(*map(own, docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, white space apart."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of which a twentieth or more stands in the benchmark."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = stored_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
