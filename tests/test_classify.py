import pytest
from pyspark.sql import functions as F

from veritext.operators import classify as C

CASES = [
    (200, "text/html", {}, "Home", "long " * 300, False, "ok"),
    (429, "text/html", {}, "", "", False, "rate_limited"),
    (404, None, {}, "", "", False, "not_found"),
    (410, "", {}, "", "", False, "not_found"),
    (503, "text/html", {}, "Just a moment...", "", False, "server_error"),
    (403, "text/html", {}, "Just a moment...", "", False, "challenge"),
    (403, "text/html", {}, "Denied", "no", False, "blocked"),
    (451, "text/html", {}, "", "", False, "blocked"),
    (999, "text/html", {}, "", "", False, "ok"),
    (0, "text/html", {}, "", "", False, "unknown"),
    (None, "text/html", {}, "", "", False, "unknown"),
    (200, "application/pdf", {}, "", "", False, "unsupported_content"),
    (200, "application/vnd.api+json; charset=x", {}, "", "", False, "ok"),
    (200, " Application/XML ;q=1", {}, "", "", False, "ok"),
    (200, "image/png", {"CF-Mitigated": " Challenge "}, "", "", False, "challenge"),
    (200, "text/html", {"X-DD-B": "3"}, "", "", False, "challenge"),
    (200, "text/html", {"server": "cloudflare"}, "", "", False, "ok"),
    (200, "text/html", {"x-amzn-waf-action": "captcha"}, "", "", False, "challenge"),
    (200, "text/html", {}, "Just a Moment (2024)", "word " * 200, False, "ok"),
    (404, "text/html", {}, "Just a moment...", "", False, "not_found"),
    (200, "application/pdf", {}, "", "", True, "challenge"),
    (200, "text/html", {}, "x" * 2_000_000, "verify you are human", False, "challenge"),
]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(i, *c) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, status int, mime string, headers map<string,string>, title string, text string, asset boolean, want string")
    c = F.col
    got = df.select("i", C.classify(c("status"), c("mime"), c("headers"), c("asset"), c("title"), c("text")).alias("v")).collect()
    return {r.i: r.v for r in got}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_table(verdicts, i):
    assert verdicts[i] == CASES[i][-1]


def test_assets(spark):
    urls = ["https://h/CDN-cgi/challenge-platform/h/orchestrate/x", "https://h/cdn-cgi/challenge-platform/scripts/jsd", "https://captcha.px-cdn.net/a", None, "https://h/article"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    assert [r[0] for r in df.orderBy("i").select(C.is_challenge_asset(F.col("u"))).collect()] == [True, False, True, False, False]


def test_not_content_is_closed():
    from veritext.functions import patterns as P

    assert set(P.NOT_CONTENT) == {"ok", "challenge", "blocked", "rate_limited", "not_found", "server_error", "unsupported_content", "unknown"} - {"ok", "unknown"}


def test_unobserved_response(spark):
    df = spark.createDataFrame([(200, "image/png", "Home", "x")], "status int, mime string, title string, text string")
    none = F.lit(None).cast("map<string,string>")
    assert df.select(C.classify(F.col("status"), F.col("mime"), none, F.lit(False), F.col("title"), F.col("text"), F.lit(False))).first()[0] == "unknown"
