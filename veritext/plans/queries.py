"""Registered queries over the sample tables, with the same in DuckDB's SQL.

The tables hold clean prose, so features are put into them by rule, in the same way on both
sides: Markdown from conversations and pages, invisible characters by doc_id, responses and
requests from events. Every query runs over its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions import text as T
from veritext.functions import urls as U
from veritext.functions.colors import color, contrast, luminance
from veritext.operators import classify as C
from veritext.operators import events as E
from veritext.operators import hits as H
from veritext.operators import pages as G
from veritext.operators import passages as R
from veritext.operators import provenance as V
from veritext.operators import sanitation as S
from veritext.plans import research as A
from veritext.streaming import limits as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs -------------------------------------------------------------------------------


def conversations_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.concat(F.lit("# "), "role", F.lit("\n\n"), "text", F.lit("\n\n"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["p"]), "").alias("markdown"))


MD = "md AS (SELECT conv_id AS id, string_agg('# ' || role || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY turn) AS md FROM conversations GROUP BY conv_id)"


def pages_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("html", "<h1>", "\n# "), "</h1>|</p>", "\n\n")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(text, "<[^>]*>", "").alias("markdown"))


PAGES_MD = r"md AS (SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(html, '<h1>', chr(10) || '# ', 'g'), '</h1>|</p>', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS md FROM pages)"

CHUNKS = r"""
l AS (SELECT id, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM (SELECT id, string_split(md, chr(10)) AS s FROM md)),
m AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
        trim(line, ' ' || chr(9) || chr(13)) = '' AS blank, regexp_matches(line, '^#{1,6}\s+') AS head FROM l),
h AS (SELECT *, last_value(CASE WHEN head AND NOT blank THEN left(trim(regexp_replace(line, '^#{1,6}\s+', '')), 200) END IGNORE NULLS) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS heading,
        sum((blank OR head)::INT) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM m),
g AS (SELECT id, island, min(off) AS "offset", first(heading ORDER BY i) AS heading, string_agg(line, chr(10) ORDER BY i) AS text FROM h WHERE NOT (blank OR head) GROUP BY id, island),
c AS (SELECT id, (row_number() OVER (PARTITION BY id ORDER BY "offset") - 1)::INT AS pos, heading, "offset", text FROM g)"""


def poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = lambda n, ch: F.concat(F.left("text", F.lit(n)), F.lit(ch), F.substring("text", n + 1, 1 << 30))
    seed = (
        F.when(F.col("doc_id") % 7 == 0, put(5, "​​"))
        .when(F.col("doc_id") % 7 == 1, put(9, "‮"))
        .when(F.col("doc_id") % 7 == 2, put(3, "\U000e0049\U000e0041"))
        .when(F.col("doc_id") % 7 == 3, put(7, "⠀"))
        .when(F.col("doc_id") % 7 == 4, put(2, "﻿ㅤ⁦\U000e0100"))
        .when(F.col("doc_id") % 7 == 5, F.concat(F.lit("­ \t"), "text", F.lit("\x07\x85 ")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", seed.alias("text"), F.col("text").alias("plain"), "source", "lang")


POISONED = """seeded AS (SELECT doc_id, text AS plain, source, lang, CASE doc_id % 7
  WHEN 0 THEN left(text, 5) || chr(8203) || chr(8203) || substr(text, 6) WHEN 1 THEN left(text, 9) || chr(8238) || substr(text, 10)
  WHEN 2 THEN left(text, 3) || chr(917577) || chr(917569) || substr(text, 4) WHEN 3 THEN left(text, 7) || chr(10240) || substr(text, 8)
  WHEN 4 THEN left(text, 2) || chr(65279) || chr(12644) || chr(8294) || chr(917760) || substr(text, 3)
  WHEN 5 THEN chr(173) || ' ' || chr(9) || text || chr(7) || chr(133) || ' ' ELSE text END AS text FROM documents)"""
STRIPPED = f"regexp_replace(regexp_replace(text, '[{P.SPACE_LIKE}]', ' ', 'g'), '[{P.ZERO_WIDTH}{P.BIDI}{P.TAG}]', '', 'g')"
SCAN = f"""scan AS (SELECT doc_id, ch, count(*) AS n, min(p) AS first FROM (SELECT doc_id, unnest(x) AS ch, generate_subscripts(x, 1) - 1 AS p FROM (
  SELECT doc_id, regexp_extract_all(text, '{P.INVISIBLE}') AS x FROM seeded)) GROUP BY doc_id, ch),
kinds AS (SELECT *, CASE WHEN unicode(ch) BETWEEN 917504 AND 917631 THEN 'tag' WHEN regexp_matches(ch, '[{P.BIDI}]') THEN 'bidi' ELSE 'zero_width' END AS category FROM scan)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda col, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(col, F.lit(len(v))) + 1).cast("int"))
    e = F.col("event_id").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        pick(e, 200, 404, 429, 503, 403, 0, 301, 410, 451, 999).alias("status"),
        pick(k, "text/html; charset=utf-8", "application/pdf", "application/JSON", "image/png", "application/vnd.api+json", "", "text/plain", " Application/XML ;q=1").alias("mime"),
        F.map_from_arrays(
            F.array(F.lit("Server"), pick(k, "x-none", "CF-Mitigated", "x-dd-b", "X-Amzn-Waf-Action", "x-none", "x-none", "x-none")),
            F.array(F.lit("edge"), pick(e, "challenge", " Captcha ", "other")),
        ).alias("headers"),
        pick(e, "Just a moment...", "Home", "News", "Attention Required! | x", "Shop").alias("title"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.repeat(F.lit("word "), 200)).when(F.pmod(k, F.lit(3)) == 1, "Please verify you are human by completing the action").otherwise("short").alias("text"),
        (F.pmod(e, F.lit(41)) == 0).alias("asset"),
    )


RESPONSES = """r AS (SELECT event_id, event_id::INT AS e, (props ->> '$.k')::INT AS k FROM events),
resp AS (SELECT event_id, [200, 404, 429, 503, 403, 0, 301, 410, 451, 999][e % 10 + 1] AS status,
  ['text/html; charset=utf-8', 'application/pdf', 'application/JSON', 'image/png', 'application/vnd.api+json', '', 'text/plain', ' Application/XML ;q=1'][k % 8 + 1] AS mime,
  ['x-none', 'CF-Mitigated', 'x-dd-b', 'X-Amzn-Waf-Action', 'x-none', 'x-none', 'x-none'][k % 7 + 1] AS hname, ['challenge', ' Captcha ', 'other'][e % 3 + 1] AS hvalue,
  ['Just a moment...', 'Home', 'News', 'Attention Required! | x', 'Shop'][e % 5 + 1] AS title, k % 3 AS body, e % 41 = 0 AS asset FROM r),
essence AS (SELECT *, lower(trim(string_split(mime, ';')[1])) AS es FROM resp),
judged AS (SELECT *, NOT (es = '' OR es LIKE 'text/%' OR es IN ('application/xml', 'application/json') OR es LIKE '%+json' OR es LIKE '%+xml') AS unsupported,
  CASE WHEN status <= 0 THEN 'unknown' WHEN status = 429 THEN 'rate_limited' WHEN status IN (404, 410) THEN 'not_found' WHEN status BETWEEN 500 AND 599 THEN 'server_error'
       WHEN status BETWEEN 400 AND 499 THEN 'blocked' ELSE 'ok' END AS base,
  lower(hname) = 'x-dd-b' OR (lower(hname) = 'cf-mitigated' AND lower(trim(hvalue)) = 'challenge') OR (lower(hname) = 'x-amzn-waf-action' AND lower(trim(hvalue)) IN ('challenge', 'captcha')) AS mitigated,
  body <> 0 AND (body = 1 OR lower(title) LIKE '%just a moment%' OR lower(title) LIKE '%attention required%') AS interstitial FROM essence),
final AS (SELECT *, CASE WHEN asset OR mitigated THEN 'challenge' WHEN unsupported THEN 'unsupported_content' WHEN base IN ('ok', 'blocked', 'unknown') AND interstitial THEN 'challenge' ELSE base END AS verdict FROM judged)"""

BAD_URLS = (None, "javascript:alert(1)", "http://u:p@h.example/x", "http:///nohost", "http://[bad", "ftp://h.example/f", "HTTPS://Mixed.Example.COM:8443/a?b#c", "http://h.example/a​b", "//h.example/x", "http://@h.example/")


def seeded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = len(BAD_URLS)
    alt = F.element_at(F.array(*[F.lit(u).cast("string") for u in BAD_URLS]), (F.pmod("page_id", F.lit(n)) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(F.col("url"), F.coalesce(alt, F.lit("")))).alias("url"))


_LIST = "[" + ", ".join("''" if u is None else "'" + u.replace("​", "' || chr(8203) || '") + "'" for u in BAD_URLS) + "]"
URLS = f"""u AS (SELECT page_id, unnest([url, {_LIST}[page_id % {len(BAD_URLS)} + 1]]) AS url FROM pages),
parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1) AS auth FROM u),
split AS (SELECT *, regexp_extract(auth, '^(.*)@', 1) AS usr, regexp_replace(auth, '^.*@', '') AS place FROM parts),
hosts AS (SELECT *, lower(CASE WHEN place LIKE '[%' THEN regexp_extract(place, '^\\[([^\\]]*)\\]', 1) ELSE regexp_extract(place, '^([^:]*)', 1) END) AS host,
  contains(auth, '[') <> contains(auth, ']') AS malformed FROM split),
faults AS (SELECT *, CASE WHEN malformed THEN 'malformed URL' WHEN scheme NOT IN ('http', 'https') THEN 'scheme not allowed: ''' || scheme || '''' WHEN usr NOT IN ('', ':') THEN 'credentials in URL are not allowed'
  WHEN host = '' THEN 'URL has no host' END AS fault FROM hosts)"""
DOMAIN = "CASE WHEN regexp_matches(host, '[.](com|net|org)$') THEN regexp_extract(host, '([^.]+[.][^.]+)$', 1) ELSE host END"


def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    bad = F.col("page_id") % 9 == 0
    return p.select(
        (F.col("page_id") % 25).alias("query_id"),
        F.floor(F.col("page_id") / 25).cast("int").alias("ord"),
        F.when(bad, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url")).alias("url"),
        F.concat(F.lit("​Title\n"), F.col("page_id").cast("string"), F.repeat(F.lit("x"), (F.col("page_id") % 500).cast("int"))).alias("title"),
        F.concat(F.lit(" s‮"), F.repeat(F.lit("y"), (F.col("page_id") % 700).cast("int"))).alias("snippet"),
        F.when(F.col("page_id") % 4 == 0, "").otherwise("engine").alias("engine"),
        F.lit(None).cast("string").alias("published"),
    )


HITS = """hits AS (SELECT page_id % 25 AS query_id, (page_id // 25)::INT AS ord, CASE WHEN page_id % 9 = 0 THEN 'javascript:' || url ELSE url END AS url,
  left('Title ' || page_id || repeat('x', (page_id % 500)::INT), 300) AS title, left('s' || repeat('y', (page_id % 700)::INT), 500) AS snippet,
  CASE WHEN page_id % 4 = 0 THEN 'unknown' ELSE 'engine' END AS engine, NULL::VARCHAR AS published, page_id FROM pages),
clean AS (SELECT * FROM hits WHERE url NOT LIKE 'javascript:%')"""


# --- passages -----------------------------------------------------------------------------


@query(f"WITH {MD}, {CHUNKS} SELECT id AS conv_id, pos, heading, \"offset\", text FROM c")
def q_chunk_documents(spark, sf_dir):
    return R.chunk_table(conversations_md(spark, sf_dir), "conv_id", "markdown")


@query(f"WITH {PAGES_MD}, {CHUNKS} SELECT id AS page_id, pos, heading, \"offset\", text FROM c")
def q_chunk_pages(spark, sf_dir):
    return R.chunk_table(pages_md(spark, sf_dir), "page_id", "markdown")


TOK = "tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)"


@query(f"WITH {TOK} SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct FROM tok")
def q_tokens(spark, sf_dir):
    w = T.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"))


@query(f"WITH {TOK} SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM tok) GROUP BY term")
def q_term_df(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query(f"WITH {TOK} SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) WHERE term IN ('license', 'apache', 'the') GROUP BY doc_id, term")
def q_term_tf(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in ("license", "apache", "the")])
    w = T.tokens(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", F.explode(F.transform(terms, lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).cast("long").alias("tf")))).alias("p"))
    return rows.select("doc_id", "p.term", "p.tf").where("tf > 0")


@query(f"WITH {TOK} SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS avg_len FROM tok")
def q_corpus_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.size(T.tokens(F.col("text")))), 6).alias("avg_len"))


def bm25_sql(terms: list[str], source: str, pool: str) -> str:
    """SQL of the score: source(key..., w), pool: PARTITION BY columns or nothing."""
    over = f"OVER ({pool})"
    df = ", ".join(f"sum((list_contains(w, '{t}'))::INT) {over} AS df_{t}" for t in dict.fromkeys(terms))
    gain = " + ".join(
        f"CASE WHEN tf_{t} > 0 THEN ln(1 + (n - df_{t} + 0.5) / (df_{t} + 0.5)) * (tf_{t} * 2.5) / (tf_{t} + 1.5 * (0.25 + 0.75 * len(w) / (CASE WHEN mean = 0 THEN 1.0 ELSE mean END))) ELSE 0 END" for t in terms
    )
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf_{t}" for t in dict.fromkeys(terms))
    return f"st AS (SELECT *, {tf}, count(*) {over} AS n, avg(len(w)) {over} AS mean, {df} FROM {source}), sc AS (SELECT *, {gain} AS score FROM st)"


@query(f"WITH {TOK}, {bm25_sql(['apache', 'license', 'the'], 'tok', '')} SELECT doc_id, round(score, 4) AS score FROM sc WHERE score > 0")
def q_bm25_global(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.bm25(docs, "Apache license the").where("score > 0").select("doc_id", F.round("score", 4).alias("score"))


CHUNK_TOK = "ct AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM c)"
MULTI = ["the", "that", "and", "the"]


def conversation_chunks(spark, sf_dir):
    return R.chunk_table(conversations_md(spark, sf_dir), "conv_id", "markdown")


@query(f"WITH {MD}, {CHUNKS}, {CHUNK_TOK}, {bm25_sql(MULTI, 'ct', 'PARTITION BY id')} SELECT id AS conv_id, pos, round(score, 4) AS score FROM sc WHERE score > 0")
def q_bm25_per_doc(spark, sf_dir):
    return R.bm25(conversation_chunks(spark, sf_dir), "the that and the", ["conv_id"]).where("score > 0").select("conv_id", "pos", F.round("score", 4).alias("score"))


ADMIT = """ord AS (SELECT *, row_number() OVER w AS rank, sum(length(text) + 2) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM sc WHERE score > 0 WINDOW w AS ({p} ORDER BY score DESC, {t})),
adm AS (SELECT *, bool_or(NOT (used <= {n} OR rank = 1)) OVER ({p}) AS truncated FROM ord)"""


@query(
    f"WITH {MD}, {CHUNKS}, {CHUNK_TOK}, {bm25_sql(MULTI, 'ct', '')}, {ADMIT.format(p='', t='id, pos', n=80000)} "
    'SELECT id AS conv_id, pos, heading, "offset", rank::INT AS rank, round(score, 4) AS score, truncated FROM adm WHERE used <= 80000 OR rank = 1'
)
def q_rank_budget(spark, sf_dir):
    """The flagship: chunks of all conversations compete for one budget."""
    scored = R.bm25(conversation_chunks(spark, sf_dir), "the that and the")
    best = R.admitted(scored, 20_000, [], [F.col("conv_id"), F.col("pos")])
    return best.select("conv_id", "pos", "heading", "offset", "rank", F.round("score", 4).alias("score"), "truncated")


@query(
    f"WITH {MD}, {CHUNKS}, {CHUNK_TOK}, {bm25_sql(MULTI, 'ct', 'PARTITION BY id')}, {ADMIT.format(p='PARTITION BY id', t='pos', n=1200)} "
    "SELECT id AS conv_id, string_agg(text, chr(10) || chr(10) ORDER BY \"offset\") AS body, count(*)::INT AS n_matches, bool_or(truncated) AS truncated FROM adm WHERE used <= 1200 OR rank = 1 GROUP BY id"
)
def q_select_reading_order(spark, sf_dir):
    scored = R.bm25(conversation_chunks(spark, sf_dir), "the that and the", ["conv_id"])
    best = R.admitted(scored, 300, ["conv_id"], [F.col("pos")])
    return R.in_reading_order(best, "conv_id").select("conv_id", "body", F.size("matches").alias("n_matches"), "truncated")


@query(
    rf"""WITH {MD}, h AS (SELECT id, md, left(md, 2000) AS head FROM md), k AS (SELECT *, strpos(reverse(head), chr(10) || chr(10)) AS back FROM h)
SELECT id AS conv_id, CASE WHEN length(md) <= 2000 THEN md ELSE regexp_replace(CASE WHEN back > 0 AND length(head) - back - 1 > 0 THEN left(head, length(head) - back - 1) ELSE head END, '\s+$', '') || chr(10) || chr(10) || '[... truncated]' END AS content,
       length(md) > 2000 AS truncated FROM k"""
)
def q_truncate(spark, sf_dir):
    return conversations_md(spark, sf_dir).select("conv_id", T.truncated(F.col("markdown"), 500).alias("content"), T.is_truncated(F.col("markdown"), 500).alias("truncated"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 - 2 > 0 THEN doc_id % 5 - 2 ELSE 20000 END::INT AS budget FROM documents")
def q_token_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_budget((F.col("doc_id") % 5 - 2).cast("int")).alias("budget"))


# --- invisible characters -----------------------------------------------------------------


@query(f"WITH {POISONED}, {SCAN} SELECT doc_id, ch AS char, category, n, first::INT AS first FROM kinds")
def q_invisible_counts(spark, sf_dir):
    return S.invisible_counts(poisoned(spark, sf_dir), "doc_id", "text")


@query(f"WITH {POISONED}, {SCAN} SELECT doc_id, ch AS char, category, n FROM kinds")
def q_merged_counts(spark, sf_dir):
    p = poisoned(spark, sf_dir)
    scans = [S.invisible_counts(p, "doc_id", "text"), S.invisible_counts(p.select("doc_id", "plain"), "doc_id", "plain"), S.invisible_counts(p, "doc_id", "text")]
    return S.merged_counts(scans, "doc_id").drop("seen")


@query(f"WITH {POISONED} SELECT doc_id, {STRIPPED} AS clean FROM seeded")
def q_strip_invisible(spark, sf_dir):
    return poisoned(spark, sf_dir).select("doc_id", T.strip_invisible(F.col("text")).alias("clean"))


@query(rf"WITH {POISONED} SELECT doc_id, nullif(left(regexp_replace(regexp_replace({STRIPPED}, '[\x00-\x1F\x7F-\x{{9F}}]', ' ', 'g'), '^\s+|\s+$', '', 'g'), 300), '') AS field FROM seeded")
def q_clean_field(spark, sf_dir):
    return poisoned(spark, sf_dir).select("doc_id", T.clean_field(F.col("text"), P.TITLE).alias("field"))


REPORT = "reports AS (SELECT doc_id, list(category || ' ' || printf('U+%04X x%d', unicode(ch), n) ORDER BY first) AS r FROM kinds GROUP BY doc_id)"
told = lambda t: F.array_join(F.transform(t, lambda x: F.concat_ws(" ", x["type"], x["reason"])), "; ")


@query(f"WITH {POISONED}, {SCAN}, {REPORT} SELECT doc_id, array_to_string(r, '; ') AS report FROM reports")
def q_threat_report(spark, sf_dir):
    merged = S.merged_counts([S.invisible_counts(poisoned(spark, sf_dir), "doc_id", "text")], "doc_id")
    return S.character_threats(merged, "doc_id").select("doc_id", told("threats").alias("report"))


def hidden_spans(n: Column) -> Column:
    one = lambda i: F.struct(F.concat(F.lit("t"), i.cast("string")).alias("text"), F.lit("opacity<=0.05").alias("reason"), F.lit("body>p").alias("path"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), one)).otherwise(F.array().cast("array<struct<text:string,reason:string,path:string>>"))


@query(
    f"""WITH {POISONED}, {SCAN}, {REPORT}, q AS (SELECT s.doc_id, coalesce(r, []) AS chars, s.doc_id % 5 AS nh, coalesce(len(r), 0) AS nc FROM seeded s LEFT JOIN reports USING (doc_id)),
k AS (SELECT *, least(nc, greatest(1, 3 - nh)) AS kc FROM q), k2 AS (SELECT *, greatest(0, 3 - kc) AS kh FROM k), k3 AS (SELECT *, nc - kc + nh - least(nh, kh) AS dropped FROM k2)
SELECT doc_id, array_to_string(list_concat(list_concat(chars[1:kc], [('hidden_css opacity<=0.05') FOR i IN range(least(nh, kh))]), CASE WHEN dropped > 0 THEN ['report_truncated left out: ' || dropped || ' (at most 3 are listed)'] ELSE [] END), '; ') AS report FROM k3"""
)
def q_threat_cap(spark, sf_dir):
    p = poisoned(spark, sf_dir)
    chars = S.character_threats(S.merged_counts([S.invisible_counts(p, "doc_id", "text")], "doc_id"), "doc_id")
    rows = p.select("doc_id").join(chars, "doc_id", "left")
    found = F.coalesce("threats", F.array().cast(S.THREATS))
    return rows.select("doc_id", told(S.capped(found, S.hidden_threats(hidden_spans((F.col("doc_id") % 5).cast("int"))), 3)).alias("report"))


@query(
    """SELECT page_id, array_to_string(list_concat(list_concat(CASE WHEN page_id % 2 = 0 THEN ['detection_degraded'] ELSE [] END, CASE WHEN page_id % 3 = 0 THEN ['strip_incomplete'] ELSE [] END),
CASE WHEN page_id % 5 = 0 THEN ['final_url_suppressed'] ELSE [] END), ',') AS notices FROM pages"""
)
def q_threat_notices(spark, sf_dir):
    i = F.col("page_id")
    t = S.with_notices(F.array().cast(S.THREATS), i % 2 != 0, i % 3 == 0, F.when(i % 5 == 0, "").otherwise(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(t, lambda x: x["type"]), ",").alias("notices"))


@query("SELECT page_id, 't' || repeat('z', least(79, (page_id % 200)::INT)) AS text, CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE 'opacity<=0.05' END AS reason FROM pages WHERE page_id % 4 <> 0")
def q_span_cleaner(spark, sf_dir):
    i = F.col("page_id")
    span = F.struct(
        F.when(i % 4 != 0, F.concat(F.lit("​t"), F.repeat(F.lit("z"), (i % 200).cast("int")))).alias("text"), F.when(i % 3 != 0, "opacity<=0.05").otherwise("").alias("reason"), F.lit(None).cast("string").alias("path")
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(H.cleaned_spans(F.array(span))).alias("s"))
    return rows.select("page_id", "s.text", "s.reason")


@query(
    f"WITH {URLS}, p AS (SELECT page_id, url FROM pages) SELECT page_id, 'P ' || page_id AS title, CASE WHEN page_id % 6 = 0 THEN '' ELSE url END AS final_url, CASE WHEN page_id % 4 > 0 THEN (page_id % 4)::INT END AS http_status FROM p"
)
def q_boundary(spark, sf_dir):
    i = F.col("page_id")
    final = F.when(i % 6 == 0, F.concat("url", F.lit("​"))).otherwise(F.col("url"))
    fields = G.boundary(F.concat(F.lit(" P\n‮"), i.cast("string")), final, hidden_spans(F.lit(0)), (i % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", *[fields[k].alias(k) for k in ("title", "final_url", "http_status")])


# --- responses ----------------------------------------------------------------------------


@query(f"WITH {RESPONSES} SELECT event_id, verdict FROM final")
def q_classify(spark, sf_dir):
    c = F.col
    return responses(spark, sf_dir).select("event_id", C.classify(c("status"), c("mime"), c("headers"), c("asset"), c("title"), c("text")).alias("verdict"))


@query(f"WITH {RESPONSES} SELECT verdict, count(*) AS n FROM final WHERE verdict IN ('ok', 'unknown') GROUP BY verdict")
def q_not_content(spark, sf_dir):
    rows = q_classify(spark, sf_dir)
    return rows.where(C.is_content(F.col("verdict"))).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESPONSES} SELECT mime, unsupported, count(*) AS n FROM judged GROUP BY ALL")
def q_mime_support(spark, sf_dir):
    return responses(spark, sf_dir).groupBy("mime", C.is_unsupported(F.col("mime")).alias("unsupported")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESPONSES} SELECT status, base AS mapped, count(*) AS n FROM judged GROUP BY ALL")
def q_status_map(spark, sf_dir):
    return responses(spark, sf_dir).groupBy("status", C.from_status(F.col("status")).alias("mapped")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT page_id, ['https://h/cdn-cgi/challenge-platform/h/b/orchestrate/chl', 'https://geo.Captcha-Delivery.com/c.js', 'https://h/cdn-cgi/challenge-platform/scripts/jsd', url][page_id % 4 + 1] AS u,
regexp_extract(url, '//([^/]+)', 1) AS host FROM pages) SELECT host, bool_or((contains(lower(u), '/cdn-cgi/challenge-platform/') AND contains(lower(u), '/orchestrate/')) OR contains(lower(u), 'captcha-delivery.com')) AS seen FROM a GROUP BY host"""
)
def q_challenge_assets(spark, sf_dir):
    """The latch by host."""
    options = [F.lit("https://h/cdn-cgi/challenge-platform/h/b/orchestrate/chl"), F.lit("https://geo.Captcha-Delivery.com/c.js"), F.lit("https://h/cdn-cgi/challenge-platform/scripts/jsd"), F.col("url")]
    u = F.element_at(F.array(*options), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.bool_or(C.is_challenge_asset(u)).alias("seen"))


# --- addresses ----------------------------------------------------------------------------


@query(f"WITH {URLS} SELECT page_id, url, fault FROM faults")
def q_url_fault(spark, sf_dir):
    return seeded_urls(spark, sf_dir).select("page_id", "url", U.url_fault(F.col("url")).alias("fault"))


@query(f"WITH {URLS} SELECT page_id, url, CASE WHEN fault IS NULL AND url <> '' AND NOT contains(url, chr(8203)) THEN url END AS safe FROM faults")
def q_safe_url(spark, sf_dir):
    return seeded_urls(spark, sf_dir).select("page_id", "url", U.safe_url(F.col("url")).alias("safe"))


@query(
    rf"""WITH {URLS}, ports AS (SELECT *, regexp_extract(place, ':([^:\]]*)$', 1) AS port FROM hosts)
SELECT page_id, url, CASE WHEN scheme <> '' AND host <> '' AND NOT malformed THEN scheme || '://' || host || CASE WHEN port <> '' THEN ':' || port ELSE '' END
 ELSE coalesce(nullif(replace(regexp_replace(url, '^.*@', ''), chr(8203), ''), ''), '(unset)') END AS shown FROM ports"""
)
def q_redact_url(spark, sf_dir):
    return seeded_urls(spark, sf_dir).select("page_id", "url", U.redacted_url(F.col("url")).alias("shown"))


IPS = """ips AS (SELECT event_id, ((event_id * 2654435761) % 4294967296)::BIGINT AS n FROM events), addr AS (SELECT event_id, n, (n // 16777216) || '.' || ((n // 65536) % 256) || '.' || ((n // 256) % 256) || '.' || (n % 256) AS ip FROM ips)"""
BLOCKED = " OR ".join(
    f"n BETWEEN {lo} AND {hi}" for lo, hi in ((int(n.network_address), int(n.broadcast_address)) for n in map(__import__("ipaddress").ip_network, P.BLOCKED_V4))
)


def addresses(spark, sf_dir):
    n = F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))
    rows = table(spark, sf_dir, "events").select("event_id", n.alias("n"))
    octet = lambda s: (F.shiftright("n", s) % 256).cast("string")
    return rows.select("event_id", F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)).alias("ip"))


@query(f"WITH {IPS} SELECT event_id, ip, {BLOCKED} AS blocked FROM addr")
def q_blocked_ip(spark, sf_dir):
    return addresses(spark, sf_dir).select("event_id", "ip", U.blocked_v4(U.v4_number(F.col("ip"))).alias("blocked"))


@query(f"WITH {IPS} SELECT {BLOCKED} AS blocked, count(*) AS n FROM addr GROUP BY 1")
def q_cidr_join(spark, sf_dir):
    rows = addresses(spark, sf_dir).withColumn("ip_number", U.v4_number(F.col("ip")))
    return U.blocked_ranges(rows, U.cidr_table(spark)).groupBy(F.col("cidr").isNotNull().alias("blocked")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {URLS} SELECT page_id, url, CASE WHEN host <> '' THEN {DOMAIN} ELSE url END AS domain FROM hosts WHERE NOT malformed")
def q_registrable_domain(spark, sf_dir):
    return seeded_urls(spark, sf_dir).where(~U.malformed(F.col("url"))).select("page_id", "url", U.registrable_domain(F.col("url")).alias("domain"))


@query("SELECT page_id, 'https://s.example/search?q=a+b%26' || page_id || '&format=json' AS u, 'https://x.example/p?q=' || page_id AS target FROM pages")
def q_search_urls(spark, sf_dir):
    i = F.col("page_id").cast("string")
    wrapped = F.concat(F.lit("//d.example/l/?kh=1&uddg=https%3A%2F%2Fx.example%2Fp%3Fq%3D"), i, F.lit("&rut=2"))
    return table(spark, sf_dir, "pages").select("page_id", U.search_url(F.lit("https://s.example//"), F.concat(F.lit("a b&"), i)).alias("u"), U.unwrapped(wrapped).alias("target"))


# --- hits ---------------------------------------------------------------------------------


@query(f"WITH {HITS} SELECT query_id, ord, url, title, snippet, engine, published FROM clean")
def q_sanitize_hits(spark, sf_dir):
    return H.sanitized(hit_rows(spark, sf_dir))


@query(f"WITH {HITS} SELECT query_id, ord, url FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM clean) WHERE n <= 3")
def q_filter_then_limit(spark, sf_dir):
    return A.search(hit_rows(spark, sf_dir), "query_id", "ord", 3).select("query_id", "ord", "url")


@query(
    f"""WITH {HITS}, d AS (SELECT *, regexp_extract(regexp_extract(url, '//([^/:?#]+)', 1), '([^.]+[.][^.]+)$', 1) AS domain FROM clean),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY ord) AS k FROM d), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM f WHERE k = 1)
SELECT query_id, ord, domain FROM g WHERE n <= 2"""
)
def q_diverse_hits(spark, sf_dir):
    return H.diverse(H.sanitized(hit_rows(spark, sf_dir)), "query_id", "ord", 2).select("query_id", "ord", "domain")


@query(
    """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN (CASE WHEN page_id % 2 = 0 THEN 'engines_failed' ELSE 'empty' END) ELSE 'ok' END AS status, CASE WHEN page_id % 3 <> 2 THEN 0 END AS ord,
CASE WHEN page_id % 3 <> 2 THEN url END AS url, CASE WHEN page_id % 3 <> 2 THEN 'T' || page_id END AS title, CASE WHEN page_id % 3 = 0 THEN page_id / 8 WHEN page_id % 3 = 1 THEN 0.0 END AS score FROM pages"""
)
def q_envelope_parse(spark, sf_dir):
    """A5, A11, B24 over JSON made of pages."""
    i = F.col("page_id")
    score = F.when(i % 3 == 0, (i / 8).cast("string")).otherwise("1e400")
    one = F.struct(F.when(i % 3 == 2, "").otherwise(F.col("url")).alias("url"), F.concat(F.lit("T"), i.cast("string")).alias("title"), score.alias("score"))
    down = F.when(i % 2 == 0, F.array(F.array(F.lit("e1"), F.lit("timeout")))).otherwise(F.array().cast("array<array<string>>"))
    raw = table(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct(F.array(one).alias("results"), down.alias("unresponsive_engines"))).alias("body"))
    return H.parse_envelopes(raw, "page_id", "body").select("page_id", "status", "ord", "url", "title", "score")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 3 THEN -value ELSE 0.0 END AS score FROM events")
def q_score_finite(spark, sf_dir):
    i, v = F.col("event_id") % 5, F.col("value").cast("string")
    raw = F.when(i == 0, v).when(i == 1, "nan").when(i == 2, "1e999").when(i == 3, F.concat(F.lit("-"), v)).otherwise("high")
    return table(spark, sf_dir, "events").select("event_id", T.finite_score(raw).alias("score"))


@query(
    """SELECT page_id, 'ok' AS status, o::INT AS ord, CASE o WHEN 0 THEN 'First & best' ELSE 'Third' END AS title, CASE o WHEN 0 THEN 'https://x.example/p?q=' || page_id ELSE url END AS url,
CASE o WHEN 0 THEN 'a bold word' ELSE '' END AS snippet, 'duckduckgo' AS engine, CASE o WHEN 0 THEN 1.0 ELSE 0.3333 END::DOUBLE AS score FROM pages, (VALUES (0), (2)) t(o)
WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, CASE WHEN page_id % 8 = 0 THEN 'empty' ELSE 'layout_changed' END, NULL, NULL, NULL, NULL, NULL, NULL FROM pages WHERE page_id % 4 = 0"""
)
def q_serp_parse(spark, sf_dir):
    i = F.col("page_id")
    block = lambda *parts: F.concat(F.lit('<div class="result results_links"><div class="links_main result__body">'), *parts, F.lit("</div></div>"))
    link = lambda href, text: F.concat(F.lit('<h2><a class="result__a" href="'), href, F.lit(f'"> {text} </a></h2>'))
    wrapped = F.concat(F.lit("//d.example/l/?uddg=https%3A%2F%2Fx.example%2Fp%3Fq%3D"), i.cast("string"))
    page = F.concat(
        block(link(wrapped, "First &amp; best"), F.lit('<a class="result__snippet">a <b>bold</b> word</a>')),
        block(link(F.lit("javascript:alert(1)"), "Second"), F.lit("")),
        block(link(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), "Third"), F.lit("")),
    )
    html = F.when(i % 8 == 0, '<div class="no-results">none</div>').when(i % 4 == 0, "<p>other</p>").otherwise(page)
    return H.parse_result_pages(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "page_id", "html")


# --- provenance ---------------------------------------------------------------------------


@query(
    r"""SELECT doc_id, sha256(text) AS content_hash, len(regexp_extract_all(text, '\S+'))::BIGINT AS word_count,
CASE doc_id % 4 WHEN 0 THEN 'A. Writer' WHEN 1 THEN 'Meta Name' WHEN 2 THEN 'Meta Name' ELSE NULL END AS author, CASE WHEN doc_id % 4 IN (1, 2) THEN '2024-01-02' END AS published,
CASE WHEN doc_id % 3 = 0 THEN 'https://e.example/c' || doc_id WHEN doc_id % 3 = 1 THEN 'https://e.example/page' END AS canonical FROM documents"""
)
def q_provenance(spark, sf_dir):
    i = F.col("doc_id")
    none = F.lit(None).cast("string")
    author = F.when(i % 4 == 0, " A.\n Writer ").when(i % 4 == 1, F.lit("one two three four five six seven eight nine")).otherwise(none)
    meta = F.when((i % 4).isin(1, 2), F.create_map(F.lit("Author"), F.lit("Meta Name"), F.lit("article:published_time"), F.lit("2024-01-02"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    canonical = F.when(i % 3 == 0, F.concat(F.lit("https://e.example/c"), i.cast("string"))).when(i % 3 == 1, "javascript:x").otherwise(none)
    got = V.receipt(F.col("text"), author, none, canonical, meta, F.when(i % 3 == 1, "https://e.example/page").otherwise(none), F.col("lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", got.alias("p"))
    return rows.select("doc_id", "p.content_hash", "p.word_count", "p.author", "p.published", "p.canonical")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'last' ELSE 'og' END AS author, CASE WHEN doc_id % 3 = 0 THEN 'm1' ELSE 'm2' END AS modified FROM documents")
def q_meta_priority(spark, sf_dir):
    i = F.col("doc_id")
    pairs = lambda *kv: F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kv]))
    meta = pairs(
        ("Author", F.lit("first")), ("AUTHOR", F.when(i % 2 == 0, "last").otherwise("")), ("article:author", F.lit("og")), ("article:modified_time", F.when(i % 3 == 0, "m1").otherwise("")), ("DateModified", F.lit("m2"))
    )
    low = V.lower_keys(meta)
    return table(spark, sf_dir, "documents").select("doc_id", V.first_of(low, P.AUTHOR_KEYS).alias("author"), V.first_of(low, P.MODIFIED_KEYS).alias("modified"))


@query()
def q_language(spark, sf_dir):
    """No SQL; tests hold it against the lang column. Each half of the rows is labelled by a
    model of the other half."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string")) % 2).alias("half"))
    models = [V.fit_language(docs.where(F.col("half") != h)) for h in (0, 1)]
    none = F.lit(None).cast("string")
    first, second = (V.detect_language(F.when(F.col("half") == h, F.col("text")), none, models[h]) for h in (0, 1))
    return docs.select("doc_id", "lang", F.coalesce(first, second).alias("detected"))


# --- pages --------------------------------------------------------------------------------


def seeded_pages(spark, sf_dir):
    i = F.col("page_id")
    extra = (
        F.when(i % 5 == 1, F.lit('<div style="display:none">secret one</div>'))
        .when(i % 5 == 2, F.lit('<p style="color:#fff;background-color:#ffffff">secret two</p>'))
        .when(i % 5 == 3, F.lit('<!-- a comment of more than twenty characters --><span style="font-size:1px">secret three</span>'))
        .when(i % 5 == 4, F.lit('<span style="position:absolute; left:-9999px">secret four</span><p style="opacity:0.04">secret five</p>'))
        .otherwise(F.lit('<p style="color:#666">muted</p>'))
    )
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", extra).alias("html"))


@query(
    """SELECT page_id, unnest(CASE page_id % 5 WHEN 1 THEN ['display:none/visibility:hidden'] WHEN 2 THEN ['color-contrast<1.15'] WHEN 3 THEN ['font-size<4px', 'html-comment'] WHEN 4 THEN ['off-screen', 'opacity<=0.05'] ELSE [] END) AS reason,
unnest(CASE page_id % 5 WHEN 1 THEN ['secret one'] WHEN 2 THEN ['secret two'] WHEN 3 THEN ['secret three', 'a comment of more than twenty characters'] WHEN 4 THEN ['secret four', 'secret five'] ELSE [] END) AS excerpt FROM pages"""
)
def q_hidden_style(spark, sf_dir):
    rows = G.with_parsed(seeded_pages(spark, sf_dir)).select("page_id", F.explode(H.cleaned_spans(F.col("page.hidden"))).alias("s"))
    return rows.select("page_id", "s.reason", F.col("s.text").alias("excerpt"))


HIDDEN_MORE = (
    ('<div style="content-visibility:hidden">secret a</div>', "content-visibility:hidden", "secret a"),
    ('<div style="width:0px;height:0px;overflow:hidden">secret b</div>', "zero-size", "secret b"),
    ('<span style="width:1px;height:1px">secret c</span>', "sr-only-1px", "secret c"),
    ('<span style="clip:rect(0, 0, 0, 0)">secret d</span>', "clip-zero-rect", "secret d"),
    ('<p style="color:rgba(1,2,3,0.01)">secret e</p>', "text-color-transparent", "secret e"),
    ('<div style="display:contents"><p style="display:none">secret f</p></div>', "no-rendered-content", "secret f"),
    ('<div style="opacity:0"><i style="display:none">secret</i> g</div><script style="display:none">var h = 1;</script>', "opacity<=0.05", "secret g"),
    ('<div id=h><template shadowrootmode="open"><p style="display:none">secret i</p><slot></slot></template>light</div>', "display:none/visibility:hidden", "secret i"),
)


@query(
    "SELECT page_id, [" + ", ".join(f"'{r}'" for _, r, _ in HIDDEN_MORE) + "][page_id % 8 + 1] AS reason, [" + ", ".join(f"'{t}'" for _, _, t in HIDDEN_MORE) + "][page_id % 8 + 1] AS excerpt FROM pages"
)
def q_hidden_more(spark, sf_dir):
    """One finding a page, whatever lies below it."""
    extra = F.element_at(F.array(*[F.lit(h) for h, _, _ in HIDDEN_MORE]), (F.col("page_id") % 8 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("html", extra).alias("html"))
    return G.with_parsed(rows).select("page_id", F.explode(H.cleaned_spans(F.col("page.hidden"))).alias("s")).select("page_id", "s.reason", F.col("s.text").alias("excerpt"))


def fetched_rows(spark, sf_dir):
    """pages as they come from a fetch: statuses, types, and addresses that some of them ended at."""
    i = F.col("page_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (i % len(v) + 1).cast("int"))
    ended = F.when(i % 4 == 0, "http://u:p@x.example/").when(i % 7 == 0, "https://inside.example/").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", ended.alias("final_url"), pick(200, 404, 429, 503, 403, 0).alias("http_status"), pick("text/html; charset=utf-8", "application/pdf", "text/html", "", "application/json").alias("mime_type")
    )


def addresses_of(spark, sf_dir):
    host = U.host(F.col("url"))
    known = table(spark, sf_dir, "pages").select(host.alias("host")).distinct()
    public = F.array(F.lit("93.184.216.34"), F.lit("2606:2800:220:1::1"))
    ips = F.when(F.length("host") % 5 == 0, F.array(F.lit("93.184.216.34"), F.lit("10.1.2.3"))).when(F.length("host") % 5 == 1, F.array(F.lit("::1"))).otherwise(public)
    rows = known.select("host", F.explode(ips).alias("ip"))
    return rows.union(spark.createDataFrame([("inside.example", "169.254.1.1"), ("x.example", "93.184.216.34")], rows.schema))


@query(
    """WITH f AS (SELECT page_id, url, lower(regexp_extract(url, '//([^/:?#]+)', 1)) AS host, [200, 404, 429, 503, 403, 0][page_id % 6 + 1] AS st, page_id % 5 = 1 AS pdf,
  CASE WHEN page_id % 4 = 0 THEN 'http://u:p@x.example/' WHEN page_id % 7 = 0 THEN 'https://inside.example/' ELSE url END AS ended FROM pages),
r AS (SELECT *, CASE WHEN length(host) % 5 IN (0, 1) THEN 'address refused by policy' WHEN page_id % 4 = 0 THEN 'credentials in URL are not allowed' WHEN page_id % 7 = 0 THEN 'address refused by policy' END AS refused FROM f)
SELECT page_id, refused, CASE WHEN refused IS NOT NULL THEN 'blocked' WHEN pdf THEN 'unsupported_content' ELSE [('ok'), 'not_found', 'rate_limited', 'server_error', 'blocked', 'unknown'][page_id % 6 + 1] END AS retrieval_status,
  CASE WHEN page_id % 4 = 0 THEN '' ELSE ended END AS final_url, nullif(st, 0) AS http_status, CASE WHEN refused IS NULL THEN 1 ELSE 0 END AS parsed FROM r"""
)
def q_page_scan(spark, sf_dir):
    """A2: guard, re-guard, classification and boundary as one plan."""
    got = A.page_scan(fetched_rows(spark, sf_dir), addresses_of(spark, sf_dir))
    return got.select("page_id", "refused", "retrieval_status", "final_url", "http_status", F.when(F.length("page.text") > 0, 1).otherwise(0).alias("parsed"))


def parsed_pages(spark, sf_dir):
    return G.with_parsed(table(spark, sf_dir, "pages")).select("page_id", "page.*", "html")


@query("SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title FROM pages")
def q_html_title(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "title")


@query("SELECT page_id, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS lang FROM pages")
def q_html_lang(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "lang")


@query(r"SELECT page_id, len(list_filter([trim(x) FOR x IN regexp_extract_all(html, '<!--(.*?)-->', 1)], lambda c: length(c) >= 20))::INT AS n_comments FROM pages")
def q_html_comments(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", F.size("comments").alias("n_comments"))


HTML_TEXT = r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '^.*?<body[^>]*>', '', 's'), '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages),
p AS (SELECT page_id, replace(replace(replace(replace(h, '</h1><p>', '</h1>'), '<p>', chr(10)), '</p>', ''), '</article>', chr(10) || chr(10)) AS h FROM b),
n AS (SELECT page_id, regexp_replace(regexp_replace(h, '</(h1|li|ul|nav|div|footer)>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g') AS h FROM p),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS h FROM n)
SELECT page_id, trim(regexp_replace(h, '[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM e
"""
HTML_MARKDOWN = r"""
WITH a AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS h FROM pages),
s AS (SELECT page_id, regexp_extract(h, '<h1>(.*?)</h1>', 1, 's') AS title, list_transform(string_split(replace(h, '</p>', ''), '<p>')[2:], lambda x: regexp_replace(trim(replace(x, '<br>', chr(10)), ' ' || chr(10)), '\s+', ' ', 'g')) AS ps FROM a),
b AS (SELECT page_id, list_filter(list_prepend('# ' || trim(title), list_transform(ps, lambda x: CASE WHEN contains(x, '<b>') THEN regexp_replace(x, '<b>\s*(.*)$', '**\1**') ELSE x END)), lambda x: trim(x) <> '') AS parts FROM s)
SELECT page_id, replace(replace(replace(replace(array_to_string(parts, chr(10) || chr(10)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS markdown FROM b
"""


@query(HTML_TEXT)
def q_html_text(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "text")


@query(HTML_MARKDOWN)
def q_html_markdown(spark, sf_dir):
    return parsed_pages(spark, sf_dir).select("page_id", "markdown")


@query(
    rf"""WITH md AS (SELECT page_id AS id, markdown AS md FROM ({HTML_MARKDOWN})), {CHUNKS}, {CHUNK_TOK}, {bm25_sql(["the", "and", "license"], "ct", "PARTITION BY id")}, {ADMIT.format(p="PARTITION BY id", t="pos", n=800)},
picked AS (SELECT id, string_agg(text, chr(10) || chr(10) ORDER BY "offset") AS body, count(*)::INT AS n, bool_or(truncated) AS cut FROM adm WHERE used <= 800 OR rank = 1 GROUP BY id),
j AS (SELECT md.id, md.md, coalesce(body, md.md) AS b, coalesce(n, 0) AS n, coalesce(cut, false) AS cut FROM md LEFT JOIN picked USING (id)),
k AS (SELECT *, left(b, 800) AS head, strpos(reverse(left(b, 800)), chr(10) || chr(10)) AS back FROM j)
SELECT page_id, url, left(trim(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')), 300) AS title,
  CASE WHEN length(b) <= 800 THEN b ELSE regexp_replace(CASE WHEN back > 0 AND length(head) - back - 1 > 0 THEN left(head, length(head) - back - 1) ELSE head END, '\s+$', '') || chr(10) || chr(10) || '[... truncated]' END AS content,
  cut OR length(b) > 800 AS truncated, n AS n_matches, [1, 2, 2, 3, 3][page_id % 5 + 1]::INT AS n_threats, sha256(md) AS content_hash, len(regexp_extract_all(md, '\S+'))::BIGINT AS word_count
FROM k JOIN pages ON page_id = id"""
)
def q_read_url(spark, sf_dir):
    """The tool over all pages, with a query."""
    got = A.read_url(seeded_pages(spark, sf_dir), "the and license", 200)
    return got.select("page_id", "url", "title", "content", "truncated", F.size("matches").alias("n_matches"), F.size("threats").alias("n_threats"), "provenance.content_hash", "provenance.word_count")


_ENDS = [f"({c} / 255.0)" for c in ("r", "g", "b")]
_LUM = lambda c: f"CASE WHEN {c} <= 0.03928 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


@query(
    f"""WITH x AS (SELECT event_id, (event_id % 256)::DOUBLE AS r, ((event_id * 7) % 256)::DOUBLE AS g, ((event_id * 13) % 256)::DOUBLE AS b FROM events),
l AS (SELECT *, 0.2126 * {_LUM(_ENDS[0])} + 0.7152 * {_LUM(_ENDS[1])} + 0.0722 * {_LUM(_ENDS[2])} AS lum FROM x)
SELECT event_id, round(1.05 / (lum + 0.05), 6) AS ratio, 1.05 / (lum + 0.05) < 1.15 AS hidden FROM l"""
)
def q_contrast(spark, sf_dir):
    e = F.col("event_id")
    css = F.format_string("rgb(%d, %d, %d)", e % 256, (e * 7) % 256, (e * 13) % 256)
    rows = table(spark, sf_dir, "events").select("event_id", color(css).alias("fg"), color(F.lit("white")).alias("bg"))
    ratio = contrast(luminance(F.col("fg.r"), F.col("fg.g"), F.col("fg.b")), luminance(F.col("bg.r"), F.col("bg.g"), F.col("bg.b")))
    return rows.select("event_id", F.round(ratio, 6).alias("ratio"), (ratio < 1.15).alias("hidden"))


# --- events -------------------------------------------------------------------------------


def timed(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", E.seconds(F.col("ts")).alias("t"))


TIMED = "tm AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1000000 AS t FROM events)"


@query(
    f"""WITH {TIMED}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS k FROM tm),
s AS (SELECT *, max(t - k * 3600.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) + k * 3600.0::DOUBLE AS start FROM k)
SELECT user_id, event_id, round(start - t, 3) AS wait FROM s"""
)
def q_rate_limit_schedule(spark, sf_dir):
    return E.rate_limit_schedule(timed(spark, sf_dir), "user_id", "t", "event_id", 3600.0).select("user_id", "event_id", F.round("wait", 3).alias("wait"))


@query(
    f"""WITH RECURSIVE {TIMED}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM tm),
w AS (SELECT user_id, event_id, k, t, [t] AS live, true AS ok FROM o WHERE k = 1 UNION ALL
  SELECT n.user_id, n.event_id, n.k, n.t, CASE WHEN len(list_filter(w.live, lambda h: n.t - h <= 86400)) < 2 THEN list_append(list_filter(w.live, lambda h: n.t - h <= 86400), n.t) ELSE list_filter(w.live, lambda h: n.t - h <= 86400) END,
         len(list_filter(w.live, lambda h: n.t - h <= 86400)) < 2 FROM w JOIN o n ON n.user_id = w.user_id AND n.k = w.k + 1)
SELECT user_id, event_id, ok AS admitted FROM w"""
)
def q_sliding_limiter(spark, sf_dir):
    return E.sliding_limiter(timed(spark, sf_dir), "user_id", "t", "event_id", 86400.0, 2).select("user_id", "event_id", "admitted")


@query(
    f"""WITH {TIMED}, n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nxt, min(t) OVER (PARTITION BY user_id) AS first FROM tm),
q AS (SELECT user_id, min(first) AS start, min(t + 43200) AS quiet FROM n WHERE nxt IS NULL OR nxt - t >= 43200 GROUP BY user_id)
SELECT user_id, round(start, 3) AS start, round(least(quiet, start + 172800), 3) AS settled, quiet > start + 172800 AS timed_out FROM q"""
)
def q_settle(spark, sf_dir):
    got = E.settle(timed(spark, sf_dir), "user_id", "t", 43200.0, 172800.0)
    return got.select("user_id", F.round("start", 3).alias("start"), F.round("settled", 3).alias("settled"), "timed_out")


@query(
    f"""WITH {TIMED}, k AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS is_open, event_id % 3 AS request FROM tm),
d AS (SELECT *, is_open - coalesce(lag(is_open) OVER (PARTITION BY user_id, request ORDER BY t, event_id), 0) AS step FROM k),
b AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS busy, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM d),
q AS (SELECT user_id, min(t) AS start, min(CASE WHEN busy = 0 AND (nxt IS NULL OR nxt - t >= 3600) THEN t + 3600 END) AS quiet FROM b GROUP BY user_id)
SELECT user_id, round(start, 3) AS start, round(CASE WHEN quiet <= start + 864000 THEN quiet ELSE start + 864000 END, 3) AS settled, coalesce(quiet > start + 864000, true) AS timed_out FROM q"""
)
def q_settle_requests(spark, sf_dir):
    """Quiet, and nothing in flight."""
    kind = F.when(F.col("event_type").isin("view", "click"), "started").otherwise("finished")
    rows = timed(spark, sf_dir).select("user_id", "t", "event_id", kind.alias("kind"), (F.col("event_id") % 3).alias("request"))
    got = E.settle_with_requests(rows, "user_id", "t", "kind", "request", 3600.0, 864000.0, "event_id")
    return got.select("user_id", F.round("start", 3).alias("start"), F.round("settled", 3).alias("settled"), "timed_out")


@query("SELECT event_id FROM events WHERE event_id % 4 = event_id % 6 AND event_id % 3 = 1")
def q_main_responses(spark, sf_dir):
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (i % 4).alias("request_id"), (i % 6).alias("loader_id"), (i % 3).alias("frame_id"), F.lit(1).alias("top_frame_id"))
    return E.main_responses(rows).select("event_id")


@query("SELECT event_type, count(p) AS graded, count(*) FILTER (NOT p) AS failed, count(*) - count(p) AS ungraded FROM (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN value > 20 END AS p FROM events) GROUP BY event_type")
def q_graded(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 5 != 0, F.col("value") > 20).alias("passed"))
    return E.graded(rows, ["event_type"], "passed")


def requests(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "click"), "started").otherwise("finished")
    return timed(spark, sf_dir).select("user_id", (F.col("event_id") % 50).alias("request_id"), kind.alias("kind"), "t", "event_id", "event_type")


REQ = f"{TIMED}, rq AS (SELECT user_id, event_id % 50 AS request_id, CASE WHEN event_type IN ('view', 'click') THEN 'started' ELSE 'finished' END AS kind, t, event_id, event_type FROM tm)"


@query(f"WITH {REQ} SELECT user_id, request_id FROM rq WHERE kind = 'started' EXCEPT SELECT user_id, request_id FROM rq WHERE kind = 'finished'")
def q_inflight(spark, sf_dir):
    return E.in_flight(requests(spark, sf_dir), ["user_id", "request_id"])


@query(f"WITH {REQ} SELECT user_id, arg_max(event_type, (t, event_id)) AS event_type FROM rq GROUP BY user_id")
def q_latest_response(spark, sf_dir):
    return E.latest(requests(spark, sf_dir), "user_id", "event_type", "t", "event_id").select("user_id", "event_type")


@query(f"WITH {REQ} SELECT user_id, request_id, arg_min(event_type, (t, event_id)) AS event_type FROM rq GROUP BY user_id, request_id")
def q_first_response(spark, sf_dir):
    return E.first_wins(requests(spark, sf_dir), ["user_id", "request_id"], "event_type", ["t", "event_id"])


@query("SELECT CASE WHEN value <= 20 THEN 'done' ELSE 'timeout' END AS status, count(*) AS n FROM events GROUP BY 1")
def q_deadline_partition(spark, sf_dir):
    return E.by_deadline(table(spark, sf_dir, "events"), "value", 20.0).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --- research -----------------------------------------------------------------------------


def fetched_pages(spark, sf_dir):
    i = F.col("page_id")
    md = pages_md(spark, sf_dir)
    kind = F.when(i % 11 == 0, "timeout").when(i % 13 == 0, "blocked").when(i % 17 == 0, "error")
    state = F.when(i % 7 == 0, "challenge").otherwise("ok")
    p = table(spark, sf_dir, "pages").select("page_id", "url", kind.alias("failure_kind"), state.alias("status"), F.lit("Oops​: broke").alias("failure"))
    # A URL that stands twice is one page: the first one.
    first = p.join(md, "page_id").groupBy("url").agg(F.min(F.struct("page_id", "markdown", "status", "failure_kind", "failure")).alias("m"))
    return first.select("url", "m.markdown", "m.status", "m.failure_kind", "m.failure")


RESEARCH = f"""{HITS}, o3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n0 FROM clean),
dm AS (SELECT *, regexp_extract(regexp_extract(url, '//([^/:?#]+)', 1), '([^.]+[.][^.]+)$', 1) AS domain FROM o3 WHERE n0 <= 9),
fd AS (SELECT *, row_number() OVER (PARTITION BY query_id, domain ORDER BY ord) AS k FROM dm), ch AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS n FROM fd WHERE k = 1),
pg AS (SELECT url, min(page_id) AS pid FROM pages GROUP BY url),
ft AS (SELECT url, pid, CASE WHEN pid % 11 = 0 THEN 'timeout' WHEN pid % 13 = 0 THEN 'blocked' WHEN pid % 17 = 0 THEN 'error' END AS kind, CASE WHEN pid % 7 = 0 THEN 'challenge' ELSE 'ok' END AS page_status FROM pg),
src AS (SELECT query_id, ord, ch.url, title, coalesce(kind, 'ok') AS status, page_status, CASE kind WHEN 'blocked' THEN 'address refused by policy' WHEN 'timeout' THEN 'no answer before the deadline' WHEN 'error' THEN 'Oops: broke' END AS error, pid FROM ch JOIN ft USING (url) WHERE n <= 3)"""


@query(f"WITH {RESEARCH} SELECT query_id, ord, url, title, status, page_status, error FROM src")
def q_research_sources(spark, sf_dir):
    found = H.sanitized(hit_rows(spark, sf_dir))
    return A.research(found, fetched_pages(spark, sf_dir), "the and", 3, 2000)[0]


@query(
    f"""WITH {RESEARCH}, pm AS (SELECT page_id AS id, md FROM (WITH {PAGES_MD} SELECT id AS page_id, md FROM md)), md AS (SELECT id, md FROM pm WHERE id IN (SELECT pid FROM src)), {CHUNKS},
pool AS (SELECT query_id, ord, url, heading, pos, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM src JOIN c ON c.id = src.pid WHERE status = 'ok' AND page_status = 'ok'),
{bm25_sql(['the', 'and'], 'pool', 'PARTITION BY query_id')}, {ADMIT.format(p='PARTITION BY query_id', t='ord, pos', n=8000)}
SELECT query_id, rank::INT AS rank, url AS source_url, heading, round(score, 4) AS score, length(text)::INT AS chars FROM adm WHERE used <= 8000 OR rank = 1"""
)
def q_research_passages(spark, sf_dir):
    found = H.sanitized(hit_rows(spark, sf_dir))
    got = A.research(found, fetched_pages(spark, sf_dir), "the and", 3, 2000)[1]
    return got.select("query_id", "rank", "source_url", "heading", "score", F.length("text").alias("chars"))


# --- streams ------------------------------------------------------------------------------


def stream_of(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """events as a stream of several micro-batches: written to the scratch folder in order of time, a file each."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    lo, hi = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.least(F.lit(batches - 1), F.expr(f"(unix_micros(ts) - {lo or 0}) * {batches} div {max(1, (hi or 0) - (lo or 0))}"))
    path = scratch(spark)
    for i in range(batches):  # one job after the other: a file source reads in order of modification
        rows.where(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: Micro-batches that the last run of each stream took.
BATCHES: dict[str, int] = {}


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """The stream's whole output, written to the shared scratch folder."""
    spark = stream.sparkSession
    path = scratch(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/{name}")
    else:  # each batch has the whole result
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}/{name}"))
    q = writer.start()
    q.awaitTermination()
    BATCHES[name] = len(q.recentProgress)
    return spark.read.schema(stream.schema).parquet(f"{path}/{name}")


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only in local mode."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="veritext-")
    return f"{root.rstrip('/')}/veritext-{uuid.uuid4().hex}"


@query(SQL["q_rate_limit_schedule"])
def s_rate_limit(spark, sf_dir):
    got = drained(L.rate_limit_stream(stream_of(spark, sf_dir), 3600.0), "s_rate_limit")
    return got.select(F.col("key").alias("user_id"), "event_id", F.round("wait", 3).alias("wait"))


@query(SQL["q_sliding_limiter"])
def s_sliding_limiter(spark, sf_dir):
    got = drained(L.sliding_limiter_stream(stream_of(spark, sf_dir), 86400.0, 2), "s_sliding_limiter")
    return got.select(F.col("key").alias("user_id"), "event_id", "admitted")


@query(
    f"""WITH {TIMED}, n AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 43200 AS gap FROM tm),
i AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, round(min(t), 3) AS start, round(max(t) + 43200, 3) AS settled, count(*) AS events FROM i GROUP BY user_id, island"""
)
def s_settle(spark, sf_dir):
    """I2 over a stream: quiet periods of twelve hours."""
    got = drained(L.settle_stream(stream_of(spark, sf_dir), "12 hours"), "s_settle", "complete")
    return got.select(F.col("key").alias("user_id"), F.round(E.seconds(F.col("start")), 3).alias("start"), F.round(E.seconds(F.col("settled")), 3).alias("settled"), "events")


@query("SELECT user_id, epoch(date_trunc('day', ts))::BIGINT AS since, bool_or(event_id % 11 = 0) AS seen FROM events GROUP BY ALL")
def s_latch(spark, sf_dir):
    """I4: the latch by key and day."""
    got = drained(L.latch_stream(stream_of(spark, sf_dir), "event_id % 11 = 0"), "s_latch", "complete")
    return got.select(F.col("key").alias("user_id"), F.unix_seconds("since").alias("since"), "seen")
