"""Quality by a generalised additive model with pairwise interactions.

Features are shares and sizes taken from a text's bytes. Each is cut into at most `bins` bins at
quantiles of the sample. Boosting goes round the features in turn: a shallow tree on the bins of
one feature (at most three cuts) is fitted to the current residuals and added, slowly, to that
feature's lookup table. Then the pairs whose coarse grids explain most of what is left are boosted
the same way, with trees that cut one feature and then the other. A text's score is the
logistic of the intercept and its table entries: one vectorised look-up and addition per table.

Fitting uses at most `most_examples` labelled rows, those with the smallest hash of doc_id; the
sample is the only thing that reaches the driver, as one short vector a row. Scoring is row by
row where the text is read; nothing is shuffled.

Scoring adds a bin's entry for each feature and pair, nothing else; long texts are measured as a whole.

Null and empty texts have a vector of zeros and get that vector's score. Ids may be of any type; rows that
share a doc_id are one example with the mean of their vectors, and are scored one by one. Ties of the hash go by doc_id. Labels other than 0
and 1 and null ids are left out; repeated labels of a doc_id count once (the largest). With labels of
one class only, all scores are near that class's rate (Laplace-smoothed); without labels they
are 0.5. Extra columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm import _bytes as B
from veritext.llm._shared import chunks, frugal, short_batches, text_buffer

FEATURES = (
    "log_bytes", "log_words", "mean_word", "max_word", "digit_share", "upper_share", "lower_share", "space_share", "stop_share", "mark_share",
    "loud_share", "symbol_share", "beyond_ascii", "newline_share", "distinct_words", "top_word", "short_words", "words_per_stop", "repeated_lines", "no_letter_words",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = {
    "digit": _class(b"0123456789"),
    "upper": _class(bytes(range(0x41, 0x5B))),
    "lower": _class(bytes(range(0x61, 0x7B))),
    "space": ~B.SPACED,
    "stop": _class(b"."),
    "mark": _class(b",;:'\"()-"),
    "loud": _class(b"!?"),
    "symbol": _class(b"#$%&*+/<=>@[\\]^_`{|}~"),
    "beyond": _class(bytes(range(0x80, 0x100))),
    "newline": _class(b"\n"),
}


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)


def vectors(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    rows = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    safe = np.maximum(size, 1)
    count = {k: _per_row(t[buf], offs) for k, t in _CLASSES.items()}
    start, end, first = B.words(buf, offs, B.SPACED)
    n = np.diff(first).astype(np.float64)
    words = np.maximum(n, 1)
    length = (end - start).astype(np.float64)
    of = B.row_of(first)
    pre = B.prefix(buf)
    longest, distinct, top = np.zeros(rows), np.zeros(rows), np.zeros(rows)
    some = n > 0
    if len(start):
        longest[some] = np.maximum.reduceat(length, first[:-1][some])
        codes = B.span_hash(pre, start, end)
        order = np.lexsort((codes, of))
        o, c = of[order], codes[order]
        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (c[1:] != c[:-1])])
        runs = np.diff(np.r_[new, len(o)])
        distinct = np.bincount(o[new], minlength=rows).astype(np.float64)
        np.maximum.at(top, o[new], runs.astype(np.float64))
    short = np.bincount(of[length <= 2], minlength=rows) if len(of) else np.zeros(rows)
    letters = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_CLASSES["upper"][buf] | _CLASSES["lower"][buf] | _CLASSES["beyond"][buf], out=letters[1:])
    bare = np.bincount(of[letters[end] == letters[start]], minlength=rows) if len(of) else np.zeros(rows)
    # Lines that stand more than once in their text, as a share of its lines.
    line = _CLASSES["newline"]
    keep = np.ones(256, bool) & ~line
    a, z, lines_first = B.words(buf, offs, keep)
    repeated = np.zeros(rows)
    if len(a):
        lo = B.row_of(lines_first)
        lc = B.span_hash(pre, a, z)
        order = np.lexsort((lc, lo))
        o, c = lo[order], lc[order]
        again = np.r_[False, (o[1:] == o[:-1]) & (c[1:] == c[:-1])]
        repeated = np.bincount(o[again], minlength=rows) / np.maximum(np.diff(lines_first), 1)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(n), np.where(some, _sum(length, first) / words, 0), np.log1p(longest), count["digit"] / safe, count["upper"] / safe, count["lower"] / safe,
            count["space"] / safe, count["stop"] / safe, count["mark"] / safe, count["loud"] / safe, count["symbol"] / safe, count["beyond"] / safe, count["newline"] / safe,
            distinct / words, top / words, short / words, n / (1 + count["stop"]), repeated, bare / words,
        ]
    )


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0.0, np.cumsum(values)]
    return total[first[1:]] - total[first[:-1]]


class Gam:
    """Lookup tables of features and of pairs of features."""

    def __init__(self, bins: int = 32, rounds: int = 120, pairs: int = 6, pair_rounds: int = 60, pair_bins: int = 8, rate: float = 0.15, smooth: float = 5.0):
        self.bins, self.rounds, self.n_pairs, self.pair_rounds, self.pair_bins, self.rate, self.smooth = bins, rounds, pairs, pair_rounds, pair_bins, rate, smooth
        self.cuts: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        self.intercept = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        n = len(y)
        p = (y.sum() + 1) / (n + 2)
        self.intercept = float(np.log(p / (1 - p)))
        if not n or y.min() == y.max():
            return self
        cut = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
        self.cuts = [cut(x[:, j], self.bins) for j in range(x.shape[1])]
        self.coarse = [cut(x[:, j], self.pair_bins) for j in range(x.shape[1])]
        at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        score = np.full(n, self.intercept)
        for _ in range(self.rounds):
            for j, a in enumerate(at):
                g, h = self._residuals(y, score, a, len(self.tables[j]))
                step = self.rate * self._tree(g, h, 3)
                self.tables[j] += step
                score += step[a]
        small = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        gains = []
        for i in range(len(at)):
            for j in range(i + 1, len(at)):
                wide = len(self.coarse[j]) + 1
                g, h = self._residuals(y, score, small[i] * wide + small[j], (len(self.coarse[i]) + 1) * wide)
                gains.append((-float((g * g / (h + self.smooth)).sum()), i, j))
        for _, i, j in sorted(gains)[: self.n_pairs]:
            self.pairs.append((i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))))
        for _ in range(self.pair_rounds):
            for i, j, table in self.pairs:
                g, h = self._residuals(y, score, small[i] * table.shape[1] + small[j], table.size)
                step = self.rate * self._grid(g.reshape(table.shape), h.reshape(table.shape))
                table += step
                score += step[small[i], small[j]]
        return self

    def _residuals(self, y: np.ndarray, score: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    def _tree(self, g: np.ndarray, h: np.ndarray, cuts: int) -> np.ndarray:
        """A regression tree on ordered bins, grown best cut first."""
        leaves = [(0, len(g))]
        for _ in range(cuts):
            best = None
            for k, (lo, hi) in enumerate(leaves):
                if hi - lo < 2:
                    continue
                a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
                ga, ha = g[lo:hi].sum(), h[lo:hi].sum()
                gain = a * a / (b + self.smooth) + (ga - a) ** 2 / (ha - b + self.smooth) - ga * ga / (ha + self.smooth)
                c = int(np.argmax(gain))
                if gain[c] > 1e-9 and (best is None or gain[c] > best[0]):
                    best = (gain[c], k, lo + c + 1)
            if best is None:
                break
            _, k, c = best
            lo, hi = leaves.pop(k)
            leaves += [(lo, c), (c, hi)]
        out = np.zeros(len(g))
        for lo, hi in leaves:
            out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + self.smooth)
        return out

    def _grid(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree that cuts one feature once and then, on either side, the other."""
        best, out = -1.0, np.zeros_like(g)
        for turned in (False, True):
            a, b = (g.T, h.T) if turned else (g, h)
            for c in range(1, a.shape[0]):
                upper, lower = self._tree(a[:c].sum(0), b[:c].sum(0), 1), self._tree(a[c:].sum(0), b[c:].sum(0), 1)
                step = np.vstack([np.tile(upper, (c, 1)), np.tile(lower, (a.shape[0] - c, 1))])
                gain = float((step * a).sum() - 0.5 * (step * step * b).sum())
                if gain > best:
                    best, out = gain, step.T if turned else step
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.intercept)
        if self.tables:
            for j, (c, t) in enumerate(zip(self.cuts, self.tables)):
                score += t[np.searchsorted(c, x[:, j], "right")]
            for i, j, t in self.pairs:
                score += t[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-score))


def _vectors_of(column: pa.Array) -> np.ndarray:
    buf, offs = text_buffer(column)
    got = [vectors(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]) for lo, hi in chunks(offs)]
    return np.vstack(got) if got else np.empty((0, len(FEATURES)))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column | None = None,
    most_examples: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    **options,
) -> Gam:
    """A model of a bounded sample of the labelled rows; learnable: a condition on the id."""
    short_batches(docs.sparkSession)
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if learnable is not None:
        known = known.where(learnable)
    known = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most_examples)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(F.broadcast(known), "id").select("id", "label", "text")

    def measured(batches):
        for b in batches:
            v = _vectors_of(b.column(2))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), flat], names=["id", "label", "v"])

    kind = texts.schema["id"].dataType.simpleString()
    vectors_ = texts.mapInArrow(frugal(measured), f"id {kind}, label int, v array<double>")
    # Rows that share a doc_id are one example, the mean of their vectors: a row an id comes back.
    means = [F.avg(F.col("v")[i]) for i in range(len(FEATURES))]
    got = vectors_.groupBy("id").agg(F.first("label").alias("label"), F.array(*means).alias("v")).collect()
    got.sort(key=lambda r: (r["id"], r["v"]))
    x = np.array([r["v"] for r in got]).reshape(len(got), len(FEATURES))
    return Gam(**options).fit(x, np.array([r["label"] for r in got], np.float64))


def with_quality(docs: DataFrame, model: Gam, text_column: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with a column `out`: the probability of label 1."""
    short_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        return pa.array(model.predict(_vectors_of(text)), pa.float64())

    return docs.withColumn(out, scored(F.col(text_column)))
