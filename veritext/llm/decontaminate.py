"""Benchmark decontamination: a broadcast set of hashed benchmark windows, checked word by word.

Words are runs of digits, letters and bytes beyond ASCII, A-Z in lower case. A window is `size`
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. The
hashes of all windows go to every executor, where each document's token windows are rolled over
them; a hit counts only once the words themselves agree.

Scale: where the benchmark's texts sum up to `most_bytes` or less, its windows are broadcast as flat
arrays (about five times the texts' bytes, so 40 MB at most), documents stay where they are and
nothing is shuffled. Beyond that bound nothing of the benchmark but a bitmap of its windows'
hashes (32 MB at most) is broadcast: windows of documents that are in it are joined with the
benchmark's by hash and words, and only documents with hits are joined with their findings. Both
ways give the same result. Long texts are handled as a whole; memory follows the longest text.

Null or empty texts have no words and are never contaminated. Items without words are left out;
a null item_id counts as an item but isn't listed. Repeated items count once, repeated documents
each have their row, and items that hold the same window are all listed. An empty benchmark
contaminates nothing. Columns of other names are passed through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm import _bytes as B
from veritext.llm._shared import bitmap_of, bits_for, chunks, fresh, frugal, in_bitmap, maybe_in, own, short_batches, stored, text_buffer

_HITS = "struct<n_words:bigint,spans:array<struct<lo:int,hi:int,from:int,to:int>>,items:array<string>>"


def sieve_of(codes: np.ndarray) -> np.ndarray:
    """Which low bits of hashes occur; some places a hash."""
    out = np.zeros(1 << max(16, (8 * len(codes)).bit_length()), bool)
    out[(codes & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def in_sieve(sieve: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return sieve[(codes & np.uint64(len(sieve) - 1)).astype(np.int64)]


def windows_of(texts: list[str | None], size: int):
    """(normalised bytes, per length of window: item, hash, first and last byte of each window)."""
    low = B.LOWER[np.frombuffer("\n".join(t or "" for t in texts).encode(), np.uint8)]
    offs = np.cumsum([0, *(len((t or "").encode()) + 1 for t in texts)])
    offs[-1] = max(offs[-1] - 1, 0)
    start, end, first = B.words(low, offs, B.PLAIN)
    # Words with one space between them, so that a window is a slice.
    flat = b" ".join(low[a:z].tobytes() for a, z in zip(start, end))
    begin = np.cumsum(np.r_[0, end - start + 1])
    codes, count, row = B.span_hash(B.prefix(low), start, end), np.diff(first), B.row_of(first)
    length = np.minimum(count, size)
    out = {}
    for n in np.unique(length[length > 0]).tolist():
        g, ok = B.grams(codes, n), B.within(first, n)
        at = np.flatnonzero(ok & (length[row[: len(g)]] == n))
        out[n] = row[at], g[at], begin[at], begin[at + n] - 1
    return flat, out


class Windows:
    """All windows of some benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int):
        self.ids = [i for i, _ in items]
        self.flat, found = windows_of([t for _, t in items], size)
        self.known = {}
        for n, (item, code, lo, hi) in found.items():
            order = np.argsort(code, kind="stable")
            self.known[n] = code[order], item[order].astype(np.int32), lo[order].astype(np.int32), hi[order].astype(np.int32)
        self.sieve = {n: sieve_of(x[0]) for n, x in self.known.items()}

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, list, set]]:
        """Per row: number of words, hit word spans with their byte ranges, numbers of items."""
        low = B.LOWER[buf]
        start, end, first = B.words(low, offs, B.PLAIN)
        out = [(int(n), [], set()) for n in np.diff(first)]
        if not self.known or not len(start):
            return out
        codes = B.span_hash(B.prefix(low), start, end)
        raw, rows = low.tobytes(), B.row_of(first)
        found: list[tuple[int, int]] = []
        for n, (known, item, lo, hi) in self.known.items():
            g = B.grams(codes, n)
            at = np.flatnonzero(in_sieve(self.sieve[n], g) & B.within(first, n))
            left, right = np.searchsorted(known, g[at], "left"), np.searchsorted(known, g[at], "right")
            for i, x, y in zip(at.tolist(), left.tolist(), right.tolist()):
                if x < y:
                    text = b" ".join(raw[start[j] : end[j]] for j in range(i, i + n))
                    same = [int(item[k]) for k in range(x, y) if self.flat[lo[k] : hi[k]] == text]
                    if same:
                        out[rows[i]][2].update(same)
                        found.append((i, i + n))
        for lo, hi in sorted(found):
            r = int(rows[lo])
            spans = out[r][1]
            if spans and lo <= spans[-1][1] + first[r]:
                spans[-1][1] = max(spans[-1][1], int(hi - first[r]))
                spans[-1][3] = max(spans[-1][3], int(end[hi - 1] - offs[r]))
            else:
                spans.append([int(lo - first[r]), int(hi - first[r]), int(start[lo] - offs[r]), int(end[hi - 1] - offs[r])])
        return out

    def batch(self, column: pa.Array) -> pa.Array:
        buf, offs = text_buffer(column)
        got = []
        for lo, hi in chunks(offs):
            got += self.scan(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        one = pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("from", pa.int32()), ("to", pa.int32())])
        kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(one)), ("items", pa.list_(pa.string()))])
        return pa.array(
            [
                {"n_words": n, "spans": [dict(zip(("lo", "hi", "from", "to"), s)) for s in spans], "items": [self.ids[k] for k in sorted(items)]}
                for n, spans, items in got
            ],
            kind,
        )


def scan_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    most_bytes: int = 8 << 20,
    text_column: str = "text",
    benchmark_id: str = "item_id",
    benchmark_text: str = "text",
    out: str = "contamination",
) -> DataFrame:
    """docs with one more column: struct(n_words, n_hit, spans, items).

    spans are disjoint word ranges [lo, hi) with their byte ranges [from, to); items lists the
    ids of all items with an occurring window (null ids as null).
    """
    short_batches(docs.sparkSession)
    items = benchmark.select(F.col(benchmark_id).cast("string").alias("i"), F.col(benchmark_text).alias("t")).distinct()
    text = F.col(text_column)
    if (items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0) <= most_bytes:
        windows = Windows([(r["i"], r["t"]) for r in items.collect()], size)
        return docs.withColumn(out, _merged(F.array(_finder(windows)(text))))
    # Findings are known by the text's digest; documents without any pass straight through.
    found = _joined(docs.select(text.alias("t")), items, size)
    may = maybe_in(bitmap_of(found.select(F.xxhash64("sha").alias("h")), "h", bits_for(found.count())))
    sha, hits = fresh(docs, "sha", "hits")
    none = F.struct(F.lit(0).cast("bigint").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    words = none.withField("n_words", _words()(text))
    marked = docs.withColumn(sha, F.sha2(F.coalesce(text, F.lit("")), 256))
    clean = marked.where(~may(F.xxhash64(sha))).drop(sha).withColumn(out, _merged(F.array(words)))
    known = found.select(F.col("sha").alias(sha), F.struct(F.lit(0).cast("bigint").alias("n_words"), "spans", "items").alias(hits))
    hit = marked.where(may(F.xxhash64(sha))).join(known, sha, "left")
    hit = hit.withColumn(out, _merged(F.array(words, F.coalesce(F.col(hits), none)))).drop(sha, hits)
    return clean.unionByName(hit)


_SPANS = "array<struct<lo:int,hi:int,from:int,to:int>>"


def _words():
    @F.arrow_udf("bigint")
    def words(text: pa.Array) -> pa.Array:
        buf, offs = text_buffer(text)
        got = [np.diff(B.words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], B.PLAIN)[2]) for lo, hi in chunks(offs)]
        return pa.array(np.concatenate([np.empty(0, np.int64), *got]), pa.int64())

    return words


def _joined(texts: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(sha, spans, items) of the distinct texts with hits, by a join on windows; a table."""

    def cut(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            flat, found = windows_of(b.column(1).to_pylist(), size)
            for n, (item, code, lo, hi) in found.items():
                words = [flat[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_pydict({"i": pa.array([ids[k] for k in item.tolist()], pa.string()), "n": pa.array([n] * len(item), pa.int32()), "h": pa.array(code.view(np.int64)), "w": pa.array(words, pa.binary())})

    windows = stored(items.mapInArrow(frugal(cut), "i string, n int, h bigint, w binary").distinct())
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # `size` of them at most
    bits = bitmap_of(windows, "h", bits_for(windows.count()))

    def candidates(batches):
        seen: set = set()
        for b in batches:
            buf, offs = text_buffer(b.column(0))
            for a, z in chunks(offs):
                part, o = buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a]
                low = B.LOWER[part]
                start, end, first = B.words(low, o, B.PLAIN)
                codes, rows, raw = B.span_hash(B.prefix(low), start, end), B.row_of(first), low.tobytes()
                out: dict[str, list] = {k: [] for k in ("sha", "n", "h", "w", "lo", "from", "to")}
                new: dict[int, str | None] = {}
                for n in lengths:
                    g = B.grams(codes, n)
                    for i in np.flatnonzero(in_bitmap(bits, g) & B.within(first, n)).tolist():
                        r = int(rows[i])
                        if r not in new:
                            sha = hashlib.sha256(part[o[r] : o[r + 1]]).hexdigest()
                            new[r] = None if sha in seen else sha
                            seen.add(sha)
                        if new[r]:
                            w = b" ".join(raw[start[j] : end[j]] for j in range(i, i + n))
                            row = (new[r], n, int(g[i].view(np.int64)), w, int(i - first[r]), int(start[i] - o[r]), int(end[i + n - 1] - o[r]))
                            for k, v in zip(out, row):
                                out[k].append(v)
                if out["sha"]:
                    kinds = {"sha": pa.string(), "h": pa.int64(), "w": pa.binary()}
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int32())) for k, v in out.items()})

    near = texts.mapInArrow(frugal(candidates), "sha string, n int, h bigint, w binary, lo int, from int, to int")
    met = near.join(windows, ["n", "h", "w"]).groupBy("sha").agg(
        F.collect_set(F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"), "from", "to")).alias("spans"), F.collect_set(F.coalesce("i", F.lit("\0"))).alias("items")
    )
    return stored(met.withColumn("items", F.transform("items", lambda i: F.when(i != "\0", i))))


def _finder(windows: Windows):
    @F.arrow_udf(_HITS)
    def hits(text: pa.Array) -> pa.Array:
        return windows.batch(text)

    return hits


def _merged(parts: Column) -> Column:
    """The blocks' findings in one row, joined."""
    n_words = F.element_at(parts, 1)["n_words"]
    spans = F.array_sort(F.flatten(F.transform(parts, lambda p: p["spans"])))
    joined = F.aggregate(
        spans,
        F.array().cast(_SPANS),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["lo"] <= F.try_element_at(done, F.lit(-1))["hi"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.struct(
                        F.try_element_at(done, F.lit(-1))["lo"].alias("lo"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["hi"], s["hi"]).alias("hi"),
                        F.try_element_at(done, F.lit(-1))["from"].alias("from"),
                        F.greatest(F.try_element_at(done, F.lit(-1))["to"], s["to"]).alias("to"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    n_hit = F.aggregate(joined, F.lit(0).cast("bigint"), lambda a, s: a + (s["hi"] - s["lo"]))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: p["items"]))))
    return F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), joined.alias("spans"), items.alias("items"))


def judged(column: Column, least_share: int = 20) -> Column:
    """Contaminated: some word is hit, and at least one word in `least_share`."""
    return (column["n_hit"] > 0) & (column["n_hit"] * least_share >= column["n_words"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text_column: str = "text", **options) -> DataFrame:
    """docs without contaminated documents, or (mode "spans") with the hit spans of those cut out."""
    (name,) = fresh(docs, "contamination")
    got = scan_documents(docs, benchmark, text_column=text_column, out=name, **options)
    if mode == "documents":
        return got.where(~F.coalesce(judged(F.col(name)), F.lit(False))).select(*map(own, docs.columns))
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        done = []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            if t is not None and s:
                raw, kept, at = t.encode(), [], 0
                for x in s:
                    kept.append(raw[at : x["from"]])
                    at = x["to"]
                t = (b"".join(kept) + raw[at:]).decode()
            done.append(t)
        return pa.array(done, pa.string())

    spans = F.when(judged(F.col(name)), F.col(name)["spans"])
    return got.withColumn(text_column, cut(F.col(text_column), spans)).select(*map(own, docs.columns))
