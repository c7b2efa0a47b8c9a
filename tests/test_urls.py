import ipaddress
import random

from pyspark.sql import functions as F

from veritext.functions import urls as U


def one(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("u"))).collect()]


def test_faults(spark):
    urls = ["http://a.example/x", "https://a.example", "file:///etc/passwd", "javascript:alert(1)", "http://u:p@a.example/", "http:///x", "http://[bad", "//a.example", "http://@a.example/", "http://:@a.example/"]
    got = one(spark, urls, U.url_fault)
    assert [g is None for g in got] == [True, True, False, False, False, False, False, False, True, True]


def test_safe_url_is_never_rewritten(spark):
    assert one(spark, ["http://a.example/x", "http://a.example/x​", " http://a.example", "http://a.example/" + "y" * 2048, None], U.safe_url) == ["http://a.example/x", None, None, None, None]


def test_redaction(spark):
    got = one(spark, ["http://u:p@H.example:9222/a?token=1", "127.0.0.1:9222", "user:secret@host", "http://h.example:99999/", "", "ws://[::1]:80/x"], U.redacted_url)
    assert got[0] == "http://h.example:9222" and got[1] == "127.0.0.1:9222" and got[2] == "host" and "secret" not in got[2]
    assert got[4] == "(unset)"


def test_unwrapping(spark):
    got = one(spark, ["//d.example/l/?uddg=https%3A%2F%2Fx.example%2F%3Fa%3Db&rut=1", "https://x.example/", "/l/?x=1", "//d.example/l/?uddg=javascript%3Aalert(1)", "ftp://x"], U.unwrapped)
    assert got == ["https://x.example/?a=b", "https://x.example/", None, None, None]


def test_domains(spark):
    got = one(spark, ["https://a.b.example.com/x", "http://www.example.co.uk", "http://127.0.0.1:8/", "http://localhost/", "http://host.unknownsuffix/", "not a url"], U.registrable_domain)
    assert got == ["example.com", "example.co.uk", "127.0.0.1", "localhost", "host.unknownsuffix", "not a url"]


def test_blocked_addresses(spark):
    r = random.Random(3)
    ends = [str(ipaddress.ip_address(int(x) + d)) for n in U.P.BLOCKED_V4 for x in (ipaddress.ip_network(n).network_address, ipaddress.ip_network(n).broadcast_address) for d in (-1, 0, 1) if 0 <= int(x) + d < 2**32]
    ips = [*ends, *[str(ipaddress.ip_address(r.randrange(2**32))) for _ in range(500)]]

    def model(ip):
        a = ipaddress.ip_address(ip)
        return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified or a in ipaddress.ip_network("100.64.0.0/10")

    want = [bool(model(ip)) for ip in ips]
    assert one(spark, ips, lambda c: U.blocked_v4(U.v4_number(c))) == want
    six = ["::1", "fe80::1", "2606:4700::1111", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "nonsense", "fd00::1", "ff02::1"]
    assert one(spark, six, U.blocked_ip()) == [True, True, False, True, False, True, True, True]
    rows = spark.createDataFrame([(ip,) for ip in ips], "ip string").withColumn("ip_number", U.v4_number(F.col("ip")))
    joined = {r.ip: r.cidr is not None for r in U.blocked_ranges(rows, U.cidr_table(spark)).collect()}
    assert joined == dict(zip(ips, want))


def test_guard_needs_every_address_public(spark):
    urls = spark.createDataFrame([("http://a.example/",), ("http://b.example/",), ("http://c.example/",), ("ftp://a.example/",)], "url string")
    dns = spark.createDataFrame([("a.example", "93.184.216.34"), ("b.example", "93.184.216.34"), ("b.example", "10.0.0.1")], "host string, ip string")
    got = {r.url: r.refused for r in U.check_url(urls, dns).collect()}
    assert got["http://a.example/"] is None and got["http://b.example/"] == "address refused by policy"
    assert got["http://c.example/"] == "host does not resolve" and got["ftp://a.example/"].startswith("scheme")


def test_local_endpoints_and_suffixes(spark):
    got = one(spark, ["http://localhost:8/", "http://127.0.0.1/", "http://[::1]:9/", "http://10.0.0.1/", "http://localhost.example/"], U.is_local)
    assert got == [True, True, True, False, False]
    got = one(spark, ["http://a.co.in/", "http://x.b.co.in/", "http://me.github.io/p", "http://www.gov.uk/", "http://y.parliament.gov.uk/"], U.registrable_domain)
    assert got == ["a.co.in", "b.co.in", "me.github.io", "www.gov.uk", "parliament.gov.uk"]
    got = one(spark, ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5", "1.2.3.x", "", None], U.v4_number)
    assert got == [0x01020304, 0x01020304, None, None, None, None, None, None]
