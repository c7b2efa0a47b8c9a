"""Options: A9, A10, H25."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import urlsplit

from veritext.functions import patterns as P

BACKENDS = ("auto", "envelopes", "result_pages")


@dataclass(frozen=True)
class Options:
    min_delay_ms: int = 5000
    block_private_ips: bool = True
    max_tokens: int = P.DEFAULT_TOKENS
    search_backend: str = "auto"
    envelope_url: str | None = None
    max_sources: int = 5
    deadline_s: float = 90.0


def flag(value: str | None, default: bool) -> bool:
    return default if value is None else value.strip().lower() in ("1", "true", "yes", "on")


def load_options(env: Mapping[str, str] | None = None, prefix: str = "VERITEXT_") -> Options:
    """Options from environment variables; a value that can't be used is an error."""
    env = os.environ if env is None else env
    get = lambda name: env.get(prefix + name)
    backend = (get("SEARCH_BACKEND") or "auto").strip().lower()
    if backend not in BACKENDS:
        raise ValueError(f"{prefix}SEARCH_BACKEND must be one of {BACKENDS}, got {backend!r}")
    url = get("ENVELOPE_URL") or None
    if url is not None and (scheme := urlsplit(url).scheme) not in ("http", "https"):
        raise ValueError(f"{prefix}ENVELOPE_URL must be http(s), got scheme {scheme!r}")
    return Options(
        min_delay_ms=int(get("MIN_DELAY_MS") or 5000),
        block_private_ips=flag(get("BLOCK_PRIVATE_IPS"), True),
        max_tokens=int(get("MAX_TOKENS") or P.DEFAULT_TOKENS),
        search_backend=backend,
        envelope_url=url,
    )


def resolve_backend(options: Options) -> str:
    """`auto` prefers envelopes where an address for them is set."""
    if options.search_backend == "envelopes" and not options.envelope_url:
        raise ValueError("the envelopes backend needs envelope_url")
    if options.search_backend != "auto":
        return options.search_backend
    return "envelopes" if options.envelope_url else "result_pages"
