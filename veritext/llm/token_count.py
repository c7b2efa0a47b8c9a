"""Token counts by a public tokenizer, with overlap resynchronisation for huge documents.

A place between a visible character and a space that a visible character follows is a proven
stable boundary of the byte-level BPE files: no alternative of the pre-tokenising pattern, and
no added token, holds a visible character with a space after it, and matching restarts at such
a place without looking back. Tokens on its two sides never depend on each other.

* Texts of more than `chunk_chars` characters are encoded in chunks that overlap by
  `overlap_chars`, with offsets. Neighbouring chunks are spliced at a stable boundary where both
  have a token's start; when the overlap has none, the next chunk is moved back by twice the
  overlap, until it holds one or the two chunks have become one.
* Shorter texts are cut at all their stable boundaries, and the pieces (mostly words) are encoded
  by the library, each distinct piece once while it stays in a bounded cache.

The tokenizer's file is read on the driver and travels with the function (fixed size). No row is
shuffled. Special strings in texts are handled as the library does by default. Null counts as
empty: 0 tokens. Repeated rows are counted one by one, ties don't arise, ids aren't looked at. Extra
columns pass through untouched; empty tables give empty results.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm._shared import short_batches

#: A space beside other white space: such places are left whole.
_UNSAFE = re.compile(r"[ ][\s\x1c-\x1f\x85]|[\s\x1c-\x1f\x85][ ]")
_STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
CACHE = 1 << 18


class Counter:
    """Counts of one tokenizer; lives in an executor's Python worker."""

    def __init__(self, source: str, chunk_chars: int, overlap_chars: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.seen: dict[str, int] = {}

    def starts(self, text: str) -> list[int]:
        return [a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def huge(self, text: str) -> int:
        """Tokens of a text in overlapping chunks."""
        total, at, lo = 0, 0, 0  # `at`: up to here tokens are counted; `lo`: where the chunk begins
        hi = min(len(text), self.chunk)
        have = self.starts(text[:hi])
        while hi < len(text):
            overlap, spliced = self.overlap, None
            while spliced is None:
                nxt = max(hi - overlap, at)
                end = min(len(text), nxt + self.chunk + overlap)
                new = self.starts(text[nxt:end])
                if nxt == at:  # the two chunks have become one
                    spliced, mine = at, 0
                    break
                ours, theirs = {a + lo for a in have}, {a + nxt for a in new}
                common = [m.start() for m in _STABLE.finditer(text, nxt, hi) if nxt < m.start() < hi - 1]
                for p in reversed(common):
                    if p in ours and p in theirs and p > at:
                        spliced, mine = p, sum(1 for a in have if at <= a + lo < p)
                        break
                else:
                    overlap *= 2
            total += mine
            at, lo, hi, have = spliced, nxt, end, new
        return total + sum(1 for a in have if a + lo >= at)

    def pieces(self, text: str) -> list[str]:
        if _UNSAFE.search(text) is None:
            return text.split(" ")
        out, lo = [], 0
        for m in _STABLE.finditer(text):
            out.append(text[lo : m.start()])
            lo = m.start() + 1
        return [*out, text[lo:]]

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [self.pieces(t) if t and len(t) <= self.chunk else None for t in texts]
        # The first piece of a text has no space before it; all others have, and are remembered.
        heads = iter(self.tokenizer.encode_batch_fast([c[0] for c in cut if c], add_special_tokens=False))
        seen, rest = self.seen, set().union(*(c[1:] for c in cut if c))
        new = [*(rest - seen.keys())]
        if len(seen) + len(new) > CACHE:
            seen.clear()
            new = [*rest]
        for x, e in zip(new, self.tokenizer.encode_batch_fast([" " + x for x in new], add_special_tokens=False)):
            seen[x] = len(e)
        out = []
        for t, c in zip(texts, cut):
            if c:
                out.append(len(next(heads)) + sum(map(seen.__getitem__, c[1:])))
            else:
                out.append(self.huge(t) if t else 0)
        return out


_workers: dict[int, Counter] = {}


def worker(key: int, source: str, chunk_chars: int, overlap_chars: int) -> Counter:
    """The counter of this Python process; its cache outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if key not in _workers:
        _workers[key] = Counter(source, chunk_chars, overlap_chars)
    return _workers[key]


def with_token_counts(
    docs: DataFrame, tokenizer_file: str, chunk_chars: int = 32_768, overlap_chars: int = 1_024, text_column: str = "text", out: str = "n_tokens"
) -> DataFrame:
    """docs with a column `out`: the tokens of each whole text."""
    with open(tokenizer_file, encoding="utf-8") as f:
        source = f.read()
    key = hash((source, chunk_chars, overlap_chars))
    short_batches(docs.sparkSession)

    @F.arrow_udf("bigint")
    def counted(text: pa.Array) -> pa.Array:
        from veritext.llm import token_count

        counter = token_count.worker(key, source, chunk_chars, overlap_chars)
        return pa.array(counter.counts(text.to_pylist()), pa.int64())

    return docs.withColumn(out, counted(F.col(text_column)))


def token_report(docs: DataFrame, tokenizer_file: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    got = with_token_counts(rows, tokenizer_file, **options)
    return got.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
