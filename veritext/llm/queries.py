"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.llm import decontaminate, exact_dedup, license_scan, mixing, ngram_join, quality, suffix_dedup, token_count, toxicity, warc_fixity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(column: str, of: int):
    return F.crc32(F.col(column).cast("string")) % of


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learnable=_remainder("id", 3) != 1)
    got = quality.with_quality(docs, model, out="score")
    return got.select(
        "doc_id", F.coalesce(_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as WARC records against a replica in which records were damaged or lost, by their md5."""
    pages = table(spark, sf_dir, "pages")
    body = F.coalesce(F.col("html"), F.lit(""))
    mark = F.substring(F.md5(body), 1, 2)
    original = pages.select("page_id", warc_fixity.record(F.col("url"), body).alias("record"))
    damaged = F.when(mark.isin("00", "07"), F.concat(body, F.lit("?"))).otherwise(body)
    replica = pages.where(mark != "05").select("page_id", warc_fixity.record(F.col("url"), damaged).alias("record"))
    got = warc_fixity.fixity_report(original, replica)
    return got.select("file", "slot", "records", F.col("offset").alias("rec_offset"), F.col("length").alias("rec_length"), "digest", "state")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = F.col("contamination")
    return got.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["items"], ","), 256).alias("items_sha256"),
        decontaminate.judged(found).alias("contaminated"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable=_remainder("id", 5) != 0)
    got = toxicity.with_toxicity(docs, index, out="found")
    score = F.col("found")["score"]
    return got.select(
        "doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), min_len=200).drop("spans")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_decontaminate": op6_decontaminate,
    "op7_ngram_join": op7_ngram_join,
    "op8_toxicity": op8_toxicity,
    "op9_license_scan": op9_license_scan,
    "op10_suffix_dedup": op10_suffix_dedup,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    "op7_ngram_join": ngram_join.NEAR_SQL,
    "op9_license_scan": license_scan.scan_sql(),
    "op2_mix_sources": mixing.MIX_SQL.format(docs="documents"),
    "op3_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
""",
    "op5_warc_fixity": r"""
WITH r AS (SELECT page_id, substr(md5(coalesce(html, '')), 1, 2) AS mark,
             concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
                    'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS rec FROM pages)
SELECT page_id // 4096 AS file, (page_id % 4096)::INT AS slot, 1::BIGINT AS records,
       coalesce(sum(strlen(rec)) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rec_offset,
       strlen(rec) AS rec_length, sha256(rec) AS digest,
       CASE WHEN mark IN ('00', '07') THEN 'changed' WHEN mark = '05' THEN 'missing' ELSE 'same' END AS state
FROM r
""",
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT id, ws, least(13, len(ws)) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT id, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM i, unnest(range(1, len(ws) - n + 2)) AS t(k)),
sizes AS (SELECT DISTINCT n FROM i),
dg AS (SELECT doc_id, k, n, array_to_string(ws[k:k + n - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(ws) - n + 2)) AS t(k) WHERE len(ws) >= n),
hits AS (SELECT doc_id, k, n, id FROM dg JOIN iw USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
""",
}
