"""The tools over tables: read_url, search, research, status. C8.

A call of a single page becomes a plan over a table of pages; sources fail one by one, as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions.text import category, clean_field, code_label, is_truncated, strip_invisible, truncated
from veritext.functions.urls import check_url, registrable_domain, url_fault
from veritext.operators import classify, hits, pages, passages, provenance, sanitation


def source_status(kind: Column) -> Column:
    """The status of a failed fetch by its kind; no kind: ok."""
    return F.when(kind.isNull() | (kind == "none"), "ok").when(kind == "blocked", "blocked").when(kind == "timeout", "timeout").otherwise("error")


def safe_detail(kind: Column, message: Column) -> Column:
    """What may be told of a failure."""
    return (
        F.when(kind.isNull() | (kind == "none"), F.lit(None).cast("string"))
        .when(kind == "blocked", F.lit(P.REFUSED))
        .when(kind == "timeout", F.lit(P.TOO_LATE))
        .otherwise(F.coalesce(clean_field(message, P.ERROR), F.lit("fetch failed")))
    )


FETCHED = {"final_url": "string", "http_status": "int", "mime_type": "string", "headers": "map<string,string>", "challenge_asset_seen": "boolean"}


def page_scan(fetched: DataFrame, dns: DataFrame | None = None, strip: bool = True, block_private: bool = True) -> DataFrame:
    """Fetched pages (url, html and what FETCHED names, where it is there), guarded, parsed, classified and cleaned.

    The guard looks at the address asked for and at the one the page ended at; a page refused by
    it isn't parsed. dns(host, ip) has the addresses of hosts; without it only the rules
    on URLs hold. New columns: refused, retrieval_status, page, and title, final_url, hidden_spans,
    http_status, meta, canonical, lang as the boundary lets them through. One parse a page.
    """
    rows = fetched.withColumns({k: F.lit(None).cast(t) for k, t in FETCHED.items() if k not in fetched.columns})
    ended = F.coalesce("final_url", "url")
    if dns is None:
        rows = rows.withColumn("__asked", url_fault(F.col("url"))).withColumn("__ended", url_fault(ended))
    else:
        rows = check_url(rows, dns, block_private).withColumnRenamed("refused", "__asked").withColumn("__at", ended)
        rows = check_url(rows, dns, block_private, "__at").withColumnRenamed("refused", "__ended").drop("__at")
    rows = rows.withColumn("refused", F.coalesce("__asked", "__ended")).drop("__asked", "__ended")
    rows = pages.with_parsed(rows.withColumn("html", F.when(F.col("refused").isNull(), F.col("html"))), strip=strip)
    p = F.col("page")
    seen = classify.classify(F.col("http_status"), F.col("mime_type"), F.col("headers"), F.col("challenge_asset_seen"), p["title"], p["text"], F.col("http_status").isNotNull())
    kept = pages.boundary(p["title"], ended, p["hidden"], F.col("http_status"), p["meta"], p["canonical"], p["lang"])
    return rows.withColumn("retrieval_status", F.when(F.col("refused").isNotNull(), "blocked").otherwise(seen)).withColumns(kept)


def documents(
    rendered: DataFrame, include_hidden: bool = False, max_threats: int = P.THREATS_PER_PAGE, key: str = "page_id", dns: DataFrame | None = None, block_private: bool = True
) -> DataFrame:
    """Pages as grounded documents, one row a page, without a shuffle where dns isn't given.

    Invisible characters are counted where the page is parsed. refused tells why the guard kept a page out.
    """
    rows = page_scan(rendered, dns, not include_hidden, block_private)
    p = F.col("page")
    raw = F.when(F.coalesce(p["markdown"], F.lit("")) != "", p["markdown"]).otherwise(F.coalesce(p["text"], F.lit("")))
    found = F.transform(
        p["marks"],
        lambda m: F.struct(
            category(m["char"]).alias("type"), code_label(m["char"], m["n"]).alias("reason"), F.lit(None).cast("string").alias("location"), F.lit("").alias("excerpt")
        ).cast(sanitation.THREAT),
    )
    listed = sanitation.capped(found, sanitation.hidden_threats(F.col("hidden_spans")), max_threats)
    # Static markup has no layout: the reduced guarantee is disclosed.
    listed = sanitation.with_notices(listed, ~p["degraded"], F.lit(False), F.col("final_url"))
    markdown = raw if include_hidden else strip_invisible(raw)
    none = F.lit(None).cast("string")
    receipt = provenance.receipt(markdown, none, none, none, F.col("meta"), F.when(F.col("canonical") != F.col("url"), F.col("canonical")), F.col("lang"))
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return rows.select(
        key, "url", "title", markdown.alias("markdown"), listed.alias("threats"), receipt.alias("provenance"), now.alias("fetched_at"), "final_url", "http_status", "retrieval_status", "refused"
    )


def result_pages(fetched: DataFrame, dns: DataFrame | None = None, key: str = "page_id", block_private: bool = True) -> DataFrame:
    """Result pages that come through the page scan: (key, status, ord, title, url, snippet, engine, score).

    A page that was refused or is no content gives one row with its retrieval status and no hit.
    """
    rows = page_scan(fetched, dns, block_private=block_private)
    usable = F.col("refused").isNull() & classify.is_content(F.col("retrieval_status"))
    found = hits.parse_result_pages(rows.where(usable).select(key, "html"), key, "html")
    return found.unionByName(rows.where(~usable).select(key, F.col("retrieval_status").alias("status")), allowMissingColumns=True)


def not_blank(query: str | None) -> None:
    """B21."""
    if query is not None and not query.strip():
        raise ValueError("the query is blank")


def read_url(
    rendered: DataFrame, query: str | None = None, max_tokens: int | None = None, include_hidden: bool = False, key: str = "page_id", dns: DataFrame | None = None
) -> DataFrame:
    """Each page's text within the budget: its best passages for a query, or its head."""
    not_blank(query)
    budget = max_tokens if max_tokens and max_tokens > 0 else P.DEFAULT_TOKENS
    docs = documents(rendered, include_hidden, key=key, dns=dns)
    body, cut = F.col("markdown"), F.lit(False)
    none = F.array().cast("array<struct<heading:string,offset:bigint,score:double>>")
    if query:
        chunks = passages.chunk_table(docs, key, "markdown")
        best = passages.admitted(passages.bm25(chunks, query, [key]), budget, [key], [F.col("pos")])
        picked = passages.in_reading_order(best, key).withColumnRenamed("truncated", "cut")
        docs = docs.join(picked, key, "left")
        body, cut = F.coalesce("body", "markdown"), F.coalesce("cut", F.lit(False))
        docs = docs.withColumn("found", F.coalesce("matches", none))
    else:
        docs = docs.withColumn("found", none)
    return docs.select(
        key, "url", "title", truncated(body, budget).alias("content"), F.col("found").alias("matches"), (cut | is_truncated(body, budget)).alias("truncated"), "threats", "provenance", "fetched_at",
        "final_url", "http_status", "retrieval_status", "refused",
    )


def search(raw_hits: DataFrame, by: str, order: str, limit: int = 10, query: str | None = None) -> DataFrame:
    """Clean hits, then the first of them, between 1 and 25."""
    not_blank(query)
    return hits.limited(hits.sanitized(raw_hits), by, order, max(1, min(25, limit)))


def research(found: DataFrame, fetched: DataFrame, query: str, max_sources: int = 5, max_tokens: int | None = None, by: str = "query_id", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(sources, passages) for every query's hits.

    found: sanitized hits; fetched(url, markdown, status, failure_kind, failure). One page a
    registrable domain; failed pages stay as sources; pages that are no content give no passages;
    the passages of all sources of a query compete in one ranking.
    """
    not_blank(query)
    most = max(1, min(10, max_sources))
    budget = max_tokens if max_tokens and max_tokens > 0 else P.DEFAULT_TOKENS
    chosen = hits.diverse(hits.limited(found, by, order, 3 * most), by, order, most)
    joined = chosen.join(fetched, "url", "left")
    kind = F.when(F.col("status").isNull() & F.col("failure_kind").isNull(), "error").otherwise(F.col("failure_kind"))
    sources = joined.withColumn("source_status", source_status(kind)).withColumn("error", safe_detail(kind, F.col("failure")))
    usable = sources.where((F.col("source_status") == "ok") & classify.is_content(F.col("status")))
    keyed = usable.withColumn("__key", F.struct(by, order, "url"))
    chunks = passages.chunk_table(keyed, "__key", "markdown").select(F.col(f"__key.{by}").alias(by), F.col(f"__key.{order}").alias(order), F.col("__key.url").alias("source_url"), "pos", "heading", "offset", "text")
    ranked = passages.admitted(passages.bm25(chunks, query, [by]), budget, [by], [F.col(order), F.col("pos")])
    clipped = is_truncated(F.col("text"), budget)
    out = ranked.select(
        by, "rank", truncated(F.col("text"), budget).alias("text"), "source_url", "heading", F.round("score", 4).alias("score"), (F.col("truncated") | clipped).alias("truncated")
    )
    return sources.select(by, order, "url", "title", F.col("source_status").alias("status"), F.col("status").alias("page_status"), "error"), out


def status(spark: SparkSession) -> DataFrame:
    """One row that tells whether the engine runs."""
    return spark.range(1).select(F.lit(True).alias("reachable"), F.lit(spark.version).alias("version"))


def audit_hidden_text(rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """The prompt's comparison: how much a page hides, told by its threats rather than by a diff."""
    shown, every = documents(rendered, False, key=key), documents(rendered, True, key=key)
    cols = [key, F.col("threats"), F.length("markdown").alias("shown_chars")]
    return shown.select(*cols).join(every.select(key, F.length("markdown").alias("all_chars")), key).select(
        key, F.size(F.filter("threats", lambda t: t["type"] == "hidden_css")).alias("hidden"), "shown_chars", "all_chars", "threats"
    )


__all__ = ["audit_hidden_text", "documents", "page_scan", "read_url", "result_pages", "registrable_domain", "research", "safe_detail", "search", "source_status", "status"]
