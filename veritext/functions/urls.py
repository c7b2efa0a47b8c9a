"""Column expressions on URLs and addresses."""

from __future__ import annotations

import ipaddress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions.text import clean_field

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def _user(url: Column) -> Column:
    """What stands before the last @ of the authority."""
    return F.regexp_extract(F.regexp_extract(url, _AUTHORITY, 1), r"^(.*)@", 1)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), r"^.*@", "")


def host(url: Column) -> Column:
    """The lower-case host, without brackets; empty if there is none."""
    place = _host_port(url)
    return F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1)))


def port(url: Column) -> Column:
    """The port, or null; -1 if it isn't a number up to 65535."""
    raw = F.regexp_extract(_host_port(url), r":([^:\]]*)$", 1)
    number = F.when(raw.rlike("^[0-9]{1,9}$"), raw.try_cast("int"))
    return F.when(raw == "", F.lit(None).cast("int")).when(number <= 65535, number).otherwise(F.lit(-1))


def malformed(url: Column) -> Column:
    """Brackets of the authority that don't pair."""
    place = F.regexp_extract(url, _AUTHORITY, 1)
    return place.contains("[") != place.contains("]")


def url_fault(url: Column) -> Column:
    """Why a URL may not be used, or null."""
    user = F.regexp_replace(_user(url), "^:$", "")
    return (
        F.when(malformed(url), "malformed URL")
        .when(~scheme(url).isin("http", "https"), F.concat(F.lit("scheme not allowed: '"), scheme(url), F.lit("'")))
        .when(user != "", "credentials in URL are not allowed")
        .when(host(url) == "", "URL has no host")
    )


def safe_url(url: Column) -> Column:
    """The URL as it is, or null; never a rewritten one."""
    return F.when((clean_field(url, P.URL) == url) & url_fault(url).isNull(), url)


def redacted_url(url: Column) -> Column:
    """Scheme, host and port only."""
    known = (scheme(url) != "") & (host(url) != "") & ~malformed(url) & (F.coalesce(port(url), F.lit(0)) >= 0)
    tail = F.when(port(url) > 0, F.concat(F.lit(":"), port(url).cast("string"))).otherwise("")
    rest = F.coalesce(clean_field(F.regexp_replace(url, r"(?s)^.*@", ""), P.URL), F.lit("(unset)"))
    return F.when(known, F.concat(scheme(url), F.lit("://"), host(url), tail)).otherwise(rest)


def is_local(url: Column) -> Column:
    """An endpoint on this machine."""
    return host(url).isin("localhost", "127.0.0.1", "::1")


def unwrapped(href: Column) -> Column:
    """The target of a /l/?uddg= redirect, or the link itself; null unless http(s)."""
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    path = F.regexp_extract(full, _PATH, 1)
    arg = F.regexp_extract(F.concat(F.lit("&"), F.regexp_extract(full, _QUERY, 1)), r"&uddg=([^&]*)", 1)
    target = F.when(path.startswith("/l/"), F.nullif(F.try_url_decode(arg), F.lit(""))).otherwise(full)
    return F.when(scheme(target).isin("http", "https"), target)


def search_url(instance: Column, query: Column) -> Column:
    """A6."""
    return F.concat(F.regexp_replace(instance, "/+$", ""), F.lit("/search?q="), F.url_encode(query), F.lit("&format=json"))


def v4_number(ip: Column) -> Column:
    """An IPv4 address as a number, or null."""
    parts = F.transform(F.split(ip, r"\."), lambda x: F.when(F.length(x) <= 3, x.try_cast("bigint")))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, x: F.when(x < 256, n * 256 + x))
    return F.when(ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), number)


def blocked_v4(number: Column) -> Column:
    """B7 for IPv4: a fixed list of ranges, one comparison each. The number is computed once a row,
    however many ranges look at it."""

    def blocked(n: Column) -> Column:
        out = F.lit(False)
        for net in map(ipaddress.ip_network, P.BLOCKED_V4):
            out = out | n.between(int(net.network_address), int(net.broadcast_address))
        return out

    return F.transform(F.array(number), blocked)[0]


def cidr_table(spark: SparkSession, cidrs: tuple[str, ...] = P.BLOCKED_V4) -> DataFrame:
    """Ranges as rows (lo, hi, cidr, slash8), one a first octet they touch."""
    rows = []
    for net in map(ipaddress.ip_network, cidrs):
        lo, hi = int(net.network_address), int(net.broadcast_address)
        rows += [(lo, hi, str(net), o) for o in range(lo >> 24, (hi >> 24) + 1)]
    return spark.createDataFrame(rows, "lo bigint, hi bigint, cidr string, slash8 bigint")


def blocked_ranges(addresses: DataFrame, cidrs: DataFrame, number: str = "ip_number") -> DataFrame:
    """A range join by first octet: addresses with the cidr that blocks them, or null."""
    near = addresses.withColumn("slash8", F.shiftright(F.col(number), 24))
    hit = (near["slash8"] == cidrs["slash8"]) & F.col(number).between(cidrs["lo"], cidrs["hi"])
    return near.join(F.broadcast(cidrs), hit, "left").select(*[near[c] for c in addresses.columns], cidrs["cidr"])


def blocked_ip():
    """B7 for any address: IPv6 needs the standard library. Unreadable addresses are blocked."""

    @F.arrow_udf("boolean")
    def blocked(ips: pa.Array) -> pa.Array:
        carrier = ipaddress.ip_network("100.64.0.0/10")
        out = []
        for ip in ips.to_pylist():
            try:
                a = ipaddress.ip_address(ip)
            except ValueError:
                out.append(True)
                continue
            a = getattr(a, "ipv4_mapped", None) or a
            out.append(not a.is_global or a.is_multicast or a.is_reserved or (a.version == 4 and a in carrier))
        return pa.array(out, pa.bool_())

    return blocked


def registrable_domain(url: Column, suffixes: tuple[str, ...] = P.SUFFIXES) -> Column:
    """One label more than the longest known suffix; else the host, else the URL."""
    name = F.regexp_replace(host(url), r"\.$", "")
    labels = F.split(name, r"\.")
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(F.size(labels) - (k - 1), F.lit(1)), F.lit(k)), ".")
    known = F.array(*[F.lit(s) for s in suffixes])
    domain = F.lit(None).cast("string")
    for k in sorted({s.count(".") + 1 for s in suffixes}):
        domain = F.when((F.size(labels) > k) & F.array_contains(known, tail(k)), tail(k + 1)).otherwise(domain)
    return F.coalesce(domain, F.nullif(name, F.lit("")), url)


def check_url(urls: DataFrame, dns: DataFrame, block_private: bool = True, url_column: str = "url") -> DataFrame:
    """Urls with a column `refused`: the fault, or that some address of the host is blocked.

    dns(host, ip) holds every address of each host; a host without one is refused.
    """
    rows = urls.withColumn("__host", host(F.col(url_column)))
    if not block_private:
        return rows.withColumn("refused", url_fault(F.col(url_column))).drop("__host")
    bad = dns.groupBy(F.lower("host").alias("__host")).agg(F.bool_or(blocked_ip()(F.col("ip"))).alias("__bad"))
    met = rows.join(bad, "__host", "left")
    why = F.coalesce(url_fault(F.col(url_column)), F.when(F.col("__bad").isNull(), "host does not resolve").when(F.col("__bad"), P.REFUSED))
    return met.withColumn("refused", why).drop("__host", "__bad")
