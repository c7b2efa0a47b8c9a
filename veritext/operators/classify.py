"""Retrieval status of a response: B10-B17. One CASE, tiers in order, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritext.functions import patterns as P
from veritext.functions.text import strip


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def is_challenge_asset(url: Column) -> Column:
    """All parts of some marker stand in the lower-cased URL."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return _any(reduce(lambda a, b: a & b, [low.contains(p) for p in marker]) for marker in P.CHALLENGE_ASSETS)


def mitigation_header(headers: Column) -> Column:
    """A header that only mitigation sends; names in any case."""

    def told(e: Column) -> Column:
        name, value = F.lower(e["key"]), F.lower(strip(e["value"]))
        return F.coalesce(name.isin(*P.MITIGATION_PRESENT) | _any((name == k) & value.isin(*v) for k, v in P.MITIGATION_VALUES.items()), F.lit(False))

    return F.coalesce(F.exists(F.map_entries(headers), told), F.lit(False))


def is_unsupported(mime: Column) -> Column:
    """A MIME type whose body is no text; a missing one is supported."""
    essence = F.lower(strip(F.split_part(F.coalesce(mime, F.lit("")), F.lit(";"), F.lit(1))))
    textual = (essence == "") | essence.startswith("text/") | essence.isin(*P.TEXT_TYPES) | essence.endswith("+json") | essence.endswith("+xml")
    return ~textual


def from_status(code: Column) -> Column:
    """B14."""
    return (
        F.when(code.isNull() | (code <= 0), "unknown")
        .when(code == 429, "rate_limited")
        .when(code.isin(404, 410), "not_found")
        .when(code.between(500, 599), "server_error")
        .when(code.between(400, 499), "blocked")
        .otherwise("ok")
    )


def is_interstitial(title: Column, text: Column) -> Column:
    """Challenge wording on a page that shows next to nothing else. Prefixes are bounded."""
    short = F.length(strip(text)) <= P.INTERSTITIAL_CHARS
    head = F.lower(F.left(F.coalesce(title, F.lit("")), F.lit(P.TITLE)))
    body = F.lower(F.left(text, F.lit(P.SCAN_CHARS)))
    return F.coalesce(short & (_any(head.contains(s) for s in P.TITLE_SIGNS) | _any(body.contains(s) for s in P.BODY_SIGNS)), F.lit(False))


def classify(status: Column, mime: Column, headers: Column, asset_seen: Column, title: Column, text: Column, observed: Column | None = None) -> Column:
    """The tiers, each deciding before the next. observed: a response was seen at all."""
    observed = F.lit(True) if observed is None else observed
    code = from_status(F.when(observed, status))
    return (
        F.when(F.coalesce(asset_seen, F.lit(False)) | (observed & mitigation_header(headers)), "challenge")
        .when(observed & is_unsupported(mime), "unsupported_content")
        .when(code.isin("ok", "blocked", "unknown") & is_interstitial(title, text), "challenge")
        .otherwise(code)
    )


def is_content(status: Column) -> Column:
    """Unknown passes."""
    return ~status.isin(*P.NOT_CONTENT)
