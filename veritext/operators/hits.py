"""Search hits: envelopes, result pages, sanitation, diversity. C7."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions.text import clean_field, finite_score
from veritext.functions.urls import registrable_domain, safe_url, unwrapped

ENVELOPE = "results array<struct<url:string,title:string,content:string,engine:string,score:string,publishedDate:string>>, unresponsive_engines array<array<string>>"


def parse_envelopes(raw: DataFrame, key: str, body: str) -> DataFrame:
    """(key, ord, title, url, snippet, engine, score, published) and `status`.

    status: ok, no_envelope (no results array), engines_failed (nothing found, and some engine is
    reported dead), empty. Envelopes without a hit give one row with a null ord.
    """
    e = raw.select(key, F.from_json(body, ENVELOPE).alias("e"))
    hits = F.filter(F.transform(F.col("e.results"), lambda r, i: F.struct(i.alias("ord"), r.alias("r"))), lambda x: F.coalesce(x["r"]["url"], F.lit("")) != "")
    status = (
        F.when(F.col("e.results").isNull(), "no_envelope").when(F.size(hits) > 0, "ok").when(F.coalesce(F.size("e.unresponsive_engines"), F.lit(0)) > 0, "engines_failed").otherwise("empty")
    )
    rows = e.select(key, status.alias("status"), F.explode_outer(hits).alias("h"))
    r = F.col("h.r")
    return rows.select(
        key,
        "status",
        F.col("h.ord").alias("ord"),
        F.when(r.isNotNull(), F.coalesce(r["title"], F.lit(""))).alias("title"),
        r["url"].alias("url"),
        F.when(r.isNotNull(), F.coalesce(r["content"], F.lit(""))).alias("snippet"),
        F.when(r.isNotNull(), F.coalesce(r["engine"], F.lit(""))).alias("engine"),
        F.when(r.isNotNull(), finite_score(r["score"])).alias("score"),
        r["publishedDate"].alias("published"),
    )


class _ResultPage(HTMLParser):
    """Blocks of a result page: title, link and snippet of each, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.blocks: list[dict] = []
        self.open: list[tuple[int, dict]] = []
        self.into: tuple[int, dict, str] | None = None
        self.empty = False

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        cls = a.get("class") or ""
        if tag not in self.VOID:
            self.stack.append((tag, cls))
        depth = len(self.stack)
        if tag == "div" and "no-results" in cls:
            self.empty = True
        if tag == "div" and "result__body" in cls:
            block = {"href": None, "title": None, "snippet": None}
            self.blocks.append(block)
            self.open.append((depth, block))
        if tag == "a" and self.open:
            block = self.open[-1][1]
            if "result__a" in cls and block["title"] is None:
                block["href"], block["title"] = a.get("href") or "", ""
                self.into = (depth, block, "title")
            elif "result__snippet" in cls and block["snippet"] is None:
                block["snippet"] = ""
                self.into = (depth, block, "snippet")

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        depth = len(self.stack)
        if self.into and depth < self.into[0]:
            self.into = None
        while self.open and depth < self.open[-1][0]:
            self.open.pop()

    def handle_data(self, data):
        if self.into:
            self.into[1][self.into[2]] += data


def parse_result_pages(pages: DataFrame, key: str, html: str, engine: str = "duckduckgo") -> DataFrame:
    """(key, status, ord, title, url, snippet, engine, score).

    A page with neither blocks nor the no-results mark has status layout_changed.
    """
    kind = "struct<empty:boolean,blocks:array<struct<href:string,title:string,snippet:string>>>"

    @F.arrow_udf(kind)
    def blocks(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            p = _ResultPage()
            p.feed(text or "")
            p.close()
            out.append({"empty": p.empty, "blocks": p.blocks})
        one = pa.struct([("href", pa.string()), ("title", pa.string()), ("snippet", pa.string())])
        return pa.array(out, pa.struct([("empty", pa.bool_()), ("blocks", pa.list_(one))]))

    rows = pages.select(key, blocks(F.col(html)).alias("p"))
    status = F.when(F.size("p.blocks") > 0, "ok").when(F.col("p.empty"), "empty").otherwise("layout_changed")
    rows = rows.select(key, status.alias("status"), F.posexplode_outer("p.blocks").alias("ord", "b"))
    url = unwrapped(F.col("b.href"))
    kept = rows.withColumn("url", url).where(F.col("ord").isNull() | (F.col("b.title").isNotNull() & F.col("url").isNotNull()))
    trim = lambda c: F.regexp_replace(c, P.EDGES, "")
    return kept.select(
        key,
        "status",
        "ord",
        trim(F.col("b.title")).alias("title"),
        "url",
        F.when(F.col("ord").isNotNull(), F.coalesce(trim(F.col("b.snippet")), F.lit(""))).alias("snippet"),
        F.when(F.col("ord").isNotNull(), F.lit(engine)).alias("engine"),
        F.round(1 / (F.col("ord") + 1), 4).alias("score"),
    )


def sanitized(hits: DataFrame) -> DataFrame:
    """Hits whose URL may be cited, other fields cleaned and cut."""
    fixed = {
        "url": safe_url(F.col("url")),
        "title": F.coalesce(clean_field(F.col("title"), P.TITLE), F.lit("")),
        "snippet": F.coalesce(clean_field(F.col("snippet"), P.SNIPPET), F.lit("")),
        "engine": F.coalesce(clean_field(F.col("engine"), P.ENGINE), F.lit("unknown")),
        "published": clean_field(F.col("published"), P.PUBLISHED),
    }
    return hits.withColumns({k: v for k, v in fixed.items() if k in hits.columns}).where("url IS NOT NULL")


def limited(hits: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """S3: the first `most` of each group after filtering."""
    return hits.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def diverse(hits: DataFrame, by: str, order: str, most: int, url: str = "url") -> DataFrame:
    """The first hit of each registrable domain, then the first `most` of these."""
    rows = hits.withColumn("domain", registrable_domain(F.col(url)))
    first = Window.partitionBy(by, "domain").orderBy(order)
    rows = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return limited(rows, by, order, most)


def cleaned_spans(spans: Column) -> Column:
    """Hidden spans (text, reason, path) cleaned and cut; those without text go."""
    kept = F.transform(
        spans,
        lambda s: F.struct(
            clean_field(s["text"], P.EXCERPT).alias("text"),
            F.coalesce(clean_field(s["reason"], P.REASON), F.lit("unknown")).alias("reason"),
            clean_field(s["path"], P.LOCATION).alias("path"),
        ),
    )
    return F.filter(kept, lambda s: s["text"].isNotNull())
