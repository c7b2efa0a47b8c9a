import pytest
from pyspark.sql import functions as F

from veritext.operators import hits as H
from veritext.operators import pages as G
from veritext.operators import provenance as V
from veritext.operators import sanitation as S
from veritext.plans import research as A
from veritext.sources.config import load_options, resolve_backend


def spans(n):
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.struct(i.cast("string").alias("text"), F.lit("r").alias("reason"), F.lit("p").alias("path"))) if n else F.array().cast("array<struct<text:string,reason:string,path:string>>")


@pytest.mark.parametrize(("chars", "hidden", "limit"), [(0, 200, 50), (40, 20, 10), (3, 1, 10), (5, 5, 1), (0, 0, 10), (20, 0, 10)])
def test_quota(spark, chars, hidden, limit):
    found = F.transform(F.sequence(F.lit(1), F.lit(chars)), lambda i: S.notice("tag", i.cast("string"))) if chars else F.array().cast(S.THREATS)
    got = spark.range(1).select(S.capped(found, S.hidden_threats(spans(hidden)), limit).alias("t")).first().t
    keep_char = min(chars, max(limit // 2, limit - hidden))
    keep_hidden = min(hidden, max(0, limit - keep_char))
    dropped = chars + hidden - keep_char - keep_hidden
    assert [x.type for x in got].count("tag") == keep_char
    assert [x.type for x in got].count("hidden_css") == keep_hidden
    assert ([x.reason for x in got if x.type == "report_truncated"] == [f"left out: {dropped} (at most {limit} are listed)"]) == (dropped > 0)


def test_merge_takes_the_largest(spark):
    a = spark.createDataFrame([(1, "a​b​"), (2, "x")], "id int, t string")
    b = spark.createDataFrame([(1, "​‮")], "id int, t string")
    merged = S.merged_counts([S.invisible_counts(a, "id", "t"), S.invisible_counts(b, "id", "t")], "id")
    got = S.character_threats(merged, "id").first()
    assert [t.reason for t in got.threats] == ["U+200B x2", "U+202E x1"]


HTML = """<!doctype html><html lang="en"><head><title>Doc &amp; co</title><meta name="author" content="First"><meta name="author" content="Second">
<meta property="article:published_time" content="2024-01-01"><link rel="canonical" href="https://ex.com/c"><style>.sr{position:absolute;left:-5000px} #x{opacity:0}</style></head>
<body><nav>menu</nav><article><h1>Cats</h1><p>All about <a href="/cats">cats</a> and <b>dogs</b>.<p>Second<br>line</p><ul><li>one<li>two</ul>
<table><tr><th>k</th><td>v</td></tr></table><div class="sr">hidden by class</div><span id="x">hidden by id</span><p style="color: #fefefe">white on white</p>
<div style="display:none">outer <b>inner</b></div><p style="color:#666">muted stays</p><script>var a = 1;</script></article><!-- a long comment that is reported --></body></html>"""


def test_page(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, ""), (4, "<p>a<div>" * 3000)], "id int, html string")
    got = {r.id: r.page for r in G.with_parsed(df).collect()}
    p = got[1]
    assert p.title == "Doc & co" and p.lang == "en" and p.canonical == "https://ex.com/c" and p.meta["author"] == "First"
    assert [(h.text, h.reason) for h in p.hidden] == [
        ("hidden by class", "off-screen"), ("hidden by id", "opacity<=0.05"), ("white on white", "color-contrast<1.15"), ("outer inner", "display:none/visibility:hidden"),
        ("a long comment that is reported", "html-comment"),
    ]
    assert "# Cats" in p.markdown and "[cats](/cats)" in p.markdown and "**dogs**" in p.markdown and "- one\n- two" in p.markdown and "| k | v |" in p.markdown
    for secret in ("hidden by", "white on white", "outer", "menu", "var a"):
        assert secret not in p.markdown
    assert "muted stays" in p.markdown and "muted stays" in p.text and "hidden by" not in p.text
    assert got[2].markdown == "" and got[3].hidden == []
    shown = G.with_parsed(df.where("id = 1"), strip=False).first().page
    assert "white on white" in shown.markdown


@pytest.mark.parametrize("depth", [10, 198, 210, 5000])
def test_hidden_text_at_any_depth(depth):
    page = "<html><body>" + "<div>" * depth + '<div style="display:none"><p>SECRET</p></div>seen' + "</div>" * depth
    for strip in (True, False):
        got = G.parse_page(page, strip)
        assert [h["text"] for h in got["hidden"]] == ["SECRET"] and "seen" in got["text"] and "seen" in got["markdown"]
        assert ("SECRET" in got["text"]) == ("SECRET" in got["markdown"]) == (not strip)


@pytest.mark.parametrize(
    "page",
    [
        '<pre>ok<span style="display:none">SECRET</span></pre>',
        '<table><tbody style="display:none"><tr><td>SECRET</td></tr></tbody><tr><td>ok</td></tr></table>',
        '<table><tr><td style="opacity:0">SECRET</td><td>ok</td></tr></table>',
        '<div style="display:none"><article>SECRET</article></div><p>ok</p>',
        '<table><tr><td>ok<table><tr style="font-size:1px"><td>SECRET</td></tr></table></td></tr></table>',
        '<ul><li>ok</li><li hidden>SECRET</li></ul>',
        '<div style="display:contents"><p style="display:none">SECRET</p></div>ok',
    ],
)
def test_hidden_text_stays_out_of_every_block(page):
    got = G.parse_page(page, True)
    assert got["hidden"] and "SECRET" not in got["text"] + got["markdown"] and "ok" in got["text"]


def test_shadow_roots():
    """What a reader sees, once, and scanned before it is composed."""
    host = '<p>Before</p><div id="host"><template shadowrootmode="{}">{}</template>{}</div>'
    see = lambda mode, inner, light: G.parse_page(host.format(mode, inner, light), True)
    got = see("open", '<style>b{color:red}</style><b>SHADOW</b><div style="display:none">PAYLOAD</div><slot></slot>', "<span>SLOTTED</span>")
    assert "SHADOW" in got["text"] and got["text"].count("SLOTTED") == 1 and "PAYLOAD" not in got["text"] + got["markdown"]
    assert [(h["text"], h["path"]) for h in got["hidden"]] == [("PAYLOAD", "html>div#host::shadow>div")]
    assert "CLOSED" not in see("closed", "<p>CLOSED</p>", "")["text"]
    assert "FALLBACK" in (got := see("open", "<slot>FALLBACK</slot>", ""))["text"] and not got["hidden"]
    got = see("open", '<b>WRAP</b><slot></slot>', '<span style="display:none">PAYLOAD</span><i><u style="opacity:0">NESTED</u></i>')
    assert {h["text"] for h in got["hidden"]} == {"PAYLOAD", "NESTED"} and "PAYLOAD" not in got["text"] and "NESTED" not in got["text"]
    got = see("open", '<slot style="color:#fff"></slot>', "STYLED PAYLOAD")
    assert [h["text"] for h in got["hidden"]] == ["STYLED PAYLOAD"] and "PAYLOAD" not in got["text"]
    got = see("open", '<slot name="a"></slot>|<slot></slot>', '<p slot="a">NAMED</p>REST')
    assert got["text"].index("NAMED") < got["text"].index("REST")
    inner = '<p>OUTER</p><div id="in"><template shadowrootmode="open"><p>INNER</p><div style="opacity:0.01">PAYLOAD</div></template></div>'
    got = see("open", inner, "")
    assert "OUTER" in got["text"] and "INNER" in got["text"] and [h["path"] for h in got["hidden"]] == ["html>div#host::shadow>div#in::shadow>div"]
    # A style sheet in a shadow tree doesn't reach the page.
    assert not see("open", "<style>p{display:none}</style><b>x</b>", "")["hidden"]


def test_page_scan(spark):
    rows = [
        (1, "https://ok.example/a", "https://ok.example/b", HTML, 200, "text/html"), (2, "https://ok.example/a", "http://in.example/", HTML, 200, "text/html"), (3, "https://in.example/", None, HTML, 200, None),
        (4, "https://ok.example/", None, "<title>Just a moment...</title><p>x</p>", 200, None), (5, "https://ok.example/", None, None, None, None), (6, "javascript:x", None, HTML, 200, None),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, final_url string, html string, http_status int, mime_type string")
    dns = spark.createDataFrame([("ok.example", "93.184.216.34"), ("in.example", "10.0.0.1")], "host string, ip string")
    got = {r.page_id: r for r in A.page_scan(pages, dns).collect()}
    assert {k: r.retrieval_status for k, r in got.items()} == {1: "ok", 2: "blocked", 3: "blocked", 4: "challenge", 5: "unknown", 6: "blocked"}
    assert got[1].refused is None and got[1].title == "Doc & co" and got[1].meta["author"] == "First" and got[1].canonical == "https://ex.com/c" and got[1].lang == "en"
    assert all(got[i].page.text == "" and got[i].title == "" for i in (2, 3, 6))
    docs = {r.page_id: r for r in A.read_url(pages, max_tokens=100, dns=dns).collect()}
    assert docs[2].content == "" and docs[2].refused == "address refused by policy" and docs[1].provenance.canonical == "https://ex.com/c"
    plan = A.documents(pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    for call in (lambda: A.read_url(pages, "  "), lambda: A.search(pages, "page_id", "page_id", query="")):
        with pytest.raises(ValueError):
            call()


def test_boundary_cleans_metadata(spark):
    meta = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a\u200b", "x\n" + "y" * 400), ("a", "second"), ("\u200b", "gone"))]))
    got = G.boundary(F.lit(" T\u202e"), F.lit("https://h/"), spans(0), F.lit(0), meta, F.lit("javascript:x"), F.lit("en" * 40))
    row = spark.range(1).select(*[v.alias(k) for k, v in got.items()]).first()
    assert list(row.meta) == ["a"] and len(row.meta["a"]) == 300 and row.canonical is None and len(row.lang) == 35 and row.http_status is None


def test_reports_escape(spark, tmp_path):
    from veritext.sources.files import write_html_report, write_markdown_report

    rows = spark.createDataFrame([("<b>&\"x'", "a|b\nc"), (None, "*")], "k string, v string")
    write_html_report(rows, str(tmp_path / "h"), ["k", "v"], "t<")
    lines = [r.value for r in spark.read.text(str(tmp_path / "h")).collect()]
    assert any("<td>&lt;b&gt;&amp;&quot;x&#39;</td><td>a|b c</td>" in x for x in lines) and any("<title>t&lt;</title>" in x for x in lines) and "<b>" not in "".join(lines)
    write_markdown_report(rows, str(tmp_path / "m"), ["k", "v"])
    assert any("a\\|b c" in r.value for r in spark.read.text(str(tmp_path / "m")).collect())


def test_result_page_layouts(spark):
    block = '<div class="links_main result__body"><a class="result__a" href="{}">T</a><a class="result__snippet">S</a></div>'
    pages = [block.format("https://a.example/") + block.format("javascript:x") + block.format("//d/l/?uddg=https%3A%2F%2Fb.example%2F"), '<div class="no-results"></div>', "<p>x</p>", None]
    df = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    rows = H.parse_result_pages(df, "id", "html").orderBy("id", "ord").collect()
    assert [(r.id, r.status, r.url, r.score) for r in rows] == [(0, "ok", "https://a.example/", 1.0), (0, "ok", "https://b.example/", 0.3333), (1, "empty", None, None), (2, "layout_changed", None, None), (3, "layout_changed", None, None)]


def test_envelopes(spark):
    bodies = ['{"results":[{"url":"http://a","title":"t","score":2}],"answers":[]}', '{"results":[{"title":"no url"}],"unresponsive_engines":[["e","timeout"]]}', '{"results":[]}', '{"x":1}', "not json"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    rows = H.parse_envelopes(df, "id", "body").orderBy("id").collect()
    assert [(r.status, r.url, r.score) for r in rows] == [("ok", "http://a", 2.0), ("engines_failed", None, None), ("empty", None, None), ("no_envelope", None, None), ("no_envelope", None, None)]


def test_metadata_case(spark):
    meta = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("Author", "a"), ("AUTHOR", "b"), ("x", "y"))]))
    low = spark.range(1).select(V.lower_keys(meta).alias("m")).first().m
    assert low == {"author": "b", "x": "y"}


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = V.fit_language(train)
    got = held.select("lang", V.detect_language(F.col("text"), F.lit("xx"), model).alias("d")).where("length(trim(lang)) > 0").collect()
    assert sum(r.lang == r.d for r in got) / len(got) > 0.95
    short = spark.createDataFrame([("ab",), (None,), ("  ",)], "t string").select(V.detect_language(F.col("t"), F.lit("xx"), model)).collect()
    assert [r[0] for r in short] == ["xx", "xx", "xx"]


def test_research_isolates_failures(spark):
    hits = spark.createDataFrame([("q", i, f"https://h{i}.s{i}.com/", f"T{i}") for i in range(4)] + [("q", 4, "https://other.s0.com/", "T")], "query_id string, ord int, url string, title string")
    pages = spark.createDataFrame(
        [("https://h0.s0.com/", "# H\n\ncats and cats", "ok", None, None), ("https://h1.s1.com/", "cats", "challenge", None, None), ("https://h2.s2.com/", None, None, "timeout", "x"), ("https://h3.s3.com/", None, None, "other", "boom​")],
        "url string, markdown string, status string, failure_kind string, failure string",
    )
    sources, passages = A.research(hits, pages, "cats", 5)
    got = {r.ord: (r.status, r.error) for r in sources.collect()}
    assert got == {0: ("ok", None), 1: ("ok", None), 2: ("timeout", "no answer before the deadline"), 3: ("error", "boom")}
    assert [(r.source_url, r.heading) for r in passages.collect()] == [("https://h0.s0.com/", "H")]
    with pytest.raises(ValueError):
        A.research(hits, pages, "  ")


def test_read_url_bounds_every_string(spark):
    rows = spark.createDataFrame([(1, "https://ex.com/p", HTML.replace("Cats", "Cats​")), (2, None, "<p>plain</p>")], "page_id int, url string, html string")
    got = {r.page_id: r for r in A.read_url(rows, "cats", 50).collect()}
    assert "​" not in got[1].content and got[1].provenance.author == "First" and len(got[1].threats) <= 54
    assert {t.type for t in got[1].threats} >= {"hidden_css", "zero_width", "detection_degraded"}
    assert "final_url_suppressed" in {t.type for t in got[2].threats}
    assert A.read_url(rows, "zebra", 50).where("page_id = 2").first().content == "plain"
    assert A.status(spark).first().reachable


def test_options():
    assert resolve_backend(load_options({})) == "result_pages"
    assert resolve_backend(load_options({"VERITEXT_ENVELOPE_URL": "https://s"})) == "envelopes"
    with pytest.raises(ValueError):
        load_options({"VERITEXT_SEARCH_BACKEND": "x"})
    with pytest.raises(ValueError):
        load_options({"VERITEXT_ENVELOPE_URL": "file:///x"})
    with pytest.raises(ValueError):
        resolve_backend(load_options({"VERITEXT_SEARCH_BACKEND": "envelopes"}))


def test_result_pages_through_the_scan(spark):
    block = '<div class="result__body"><a class="result__a" href="https://a.example/">T</a></div>'
    rows = [(1, "https://ok.example/", block, 200), (2, "https://in.example/", block, 200), (3, "https://ok.example/", block, 429), (4, "https://ok.example/", "<p>new layout</p>", 200)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, http_status int")
    dns = spark.createDataFrame([("ok.example", "93.184.216.34"), ("in.example", "192.168.0.1")], "host string, ip string")
    got = {r.page_id: (r.status, r.url) for r in A.result_pages(pages, dns).collect()}
    assert got == {1: ("ok", "https://a.example/"), 2: ("blocked", None), 3: ("rate_limited", None), 4: ("layout_changed", None)}


def test_limits_are_clamped(spark):
    found = spark.range(40).select(F.lit("q").alias("query_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("https://h.example/"), F.col("id").cast("string")).alias("url"), F.lit("t").alias("title"), F.lit("").alias("snippet"))
    assert [A.search(found, "query_id", "ord", n).count() for n in (99, 25, 3, 0, -5)] == [25, 25, 3, 1, 1]


def test_hidden_text_is_told_by_threats(spark):
    """Pages with and without their hidden text; the root is looked at, too."""
    rows = [(1, "https://e.example/", '<p>seen</p><p style="opacity:0">unseen words</p>'), (2, "https://e.example/", '<body style="display:none">all of it</body>'), (3, "https://e.example/", "<p>plain</p>")]
    got = {r.page_id: r for r in A.audit_hidden_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [got[i].hidden for i in (1, 2, 3)] == [1, 1, 0]
    assert got[1].shown_chars < got[1].all_chars and got[2].shown_chars == 0 and got[3].shown_chars == got[3].all_chars


def test_json_bodies(spark, tmp_path):
    from veritext.sources.files import read_json_bodies

    (tmp_path / "a.json").write_text('{"results":[]}')
    (tmp_path / "b.json").write_text("x" * 100)
    got = {r.path[-6:]: (r.body, r.too_large) for r in read_json_bodies(spark, str(tmp_path), most=50).collect()}
    assert got == {"a.json": ('{"results":[]}', False), "b.json": (None, True)}
