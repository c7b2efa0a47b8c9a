"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Fitting (bounded): at most `per_class` labelled rows of each class, those with the smallest hash
of doc_id, are examples. Features are all words of the examples (A-Z in lower case, runs of digits,
letters and bytes beyond ASCII) and the first `stem` bytes of longer words; none is left out.
Features whose document frequency differs between the classes by a log-likelihood ratio of
`least_ratio` and by a factor of `least_odds`, in `least_documents` or more, weigh `boost` times as
much: under plain TF-IDF a few telling words drown in the subject of a text. Examples
of a class with the same words the same number of times, that is copies but for case, spacing and
order, count once for document frequencies; near copies count one by one.
Weights are (1 + ln tf) * idf, times boost for telling features, and vectors have length 1; words
that no example holds have no weight.

Index: examples are grouped by cluster (a few rounds of spherical k-means over the `COMMON`
most frequent features) and label, and groups are cut into blocks of `BLOCK`. For each feature it holds
the examples with it and, for the common ones, the largest weight in each block. Search: the postings
of a text's other features are added up first; that sum, plus query weight times block maximum over
the common features, bounds every similarity in a block. The groups with the blocks of the largest bounds are
finished first, then all with a block whose bound reaches the k-th best similarity found. No example that
belongs to the k nearest is lost. Similarities are rounded to 12 digits. A group's common features
are multiplied as a matrix, some dozens of texts at a time.

Vote: (m * prior + sum of s_i * label_i) / (m + sum of s_i), with s_i the similarity of
neighbour i (one less the cosine distance) and prior the share of label 1 among all labelled rows
that may be learnt from. The sample holds more toxic rows than the corpus, so the vote isn't a
rate yet. It is mapped to one by a logistic curve of two parameters, fitted on `calibrated` of the examples, each
voted on by the examples of the other folds only, and weighted by the classes' true shares. That is the score. A
text without a word of any example gets the prior, so do null and empty texts.
Neighbours are the evidence; ties go to the example with the smaller hash of its id.

Scale: every text is scored where it is read, as a whole; the broadcast index holds the words of 2 * per_class
examples, whatever the number of rows. Ids may be of any type. Labels other than 0 and 1 and null ids are left out of fitting. Without examples
of both classes all scores are the prior (0 without labels). Repeated labels of a doc_id count
once (the largest); rows that share a doc_id are one example, with the largest term frequency of each word.
Repeated rows are scored one by one. Empty tables give empty results. Extra columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from veritext.llm import _bytes as B
from veritext.llm._shared import chunks, frugal, release_memory, short_batches, text_buffer

BLOCK = 64
#: Features that are multiplied as a matrix, groups that are finished first, clusters, folds, texts at a time.
COMMON, FIRST, CLUSTERS, FOLDS, LOT = 1_000, 2, 8, 5, 128
#: Postings that are spread out at once.
POSTINGS = 1 << 19


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), one after the other, and the ranges' sizes."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), n


def document_features(buf: np.ndarray, offs: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of each longer word's stem."""
    low = B.LOWER[buf]
    start, end, first = B.words(low, offs, B.PLAIN)
    pre, rows = B.prefix(low), B.row_of(first)
    codes = B.span_hash(pre, start, end)
    long = end - start > stem
    stems = B.span_hash(pre, start[long], start[long] + stem) ^ np.uint64(0x5851F42D4C957F2D)
    return np.r_[rows, rows[long]], np.r_[codes, stems]


def clusters(x: np.ndarray, count: int = CLUSTERS, rounds: int = 6) -> np.ndarray:
    """Spherical k-means over the rows of x, from evenly spaced rows."""
    centers = x[np.linspace(0, len(x) - 1, count).astype(int)]
    for _ in range(rounds):
        of = np.argmax(x @ centers.T, axis=1)
        centers = np.array([x[of == c].sum(0) for c in range(count)])
        centers /= np.maximum(np.sqrt((centers**2).sum(1)), 1e-12)[:, None]
    return of


class Index:
    """Labelled examples in an inverted index with block maxima.

    features: sorted hashes; scale: their idf and boost; of, f, tf: the example, number of the feature and
    term frequency of each posting, examples in order of their ids' hashes; labels and ids by example.
    """

    def __init__(self, features: np.ndarray, scale: np.ndarray, of: np.ndarray, f: np.ndarray, tf: np.ndarray, labels: np.ndarray, ids: pa.Array, prior: float, k: int, mass: float, stem: int):
        self.features, self.scale, self.ids, self.prior, self.k, self.mass, self.stem = features, scale, ids, prior, k, mass, stem
        self.slope, self.shift = 1.0, 0.0
        if not len(labels):
            return
        w = (1 + np.log(tf)) * scale[f]
        w /= np.sqrt(np.bincount(of, w * w, len(labels)))[of]
        held = np.bincount(f, minlength=len(features))
        common = np.argsort(-held, kind="stable")[:COMMON]
        self.column = np.full(len(features), -1, np.int32)
        self.column[common] = np.arange(len(common))
        column = self.column[f]
        x = np.zeros((len(labels), len(common)), np.float32)
        x[of[column >= 0], column[column >= 0]] = w[column >= 0]
        group = clusters(x) * 2 + labels
        del x
        # Every group begins a block of its own; slots without an example are never near anything.
        order = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=2 * CLUSTERS)
        begin = np.cumsum(np.r_[0, -(-sizes // BLOCK) * BLOCK])
        slot = np.empty(len(labels), np.int32)
        slot[order] = np.arange(len(labels)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[:-1], sizes)
        self.blocks = int(begin[-1]) // BLOCK
        self.begin = np.unique(begin) // BLOCK  # of the groups, in blocks
        self.example = np.full(self.blocks * BLOCK, -1, np.int32)
        self.example[slot] = np.arange(len(labels))
        self.labels = np.zeros(len(self.example))
        self.labels[slot] = labels
        some = column >= 0
        self.common = column[some].astype(np.int16), slot[of[some]], w[some]
        f, number, w = f[~some], slot[of[~some]], w[~some]
        order = np.argsort(f.astype(np.int64) * len(self.example) + number)
        self.number, self.weight = number[order], w[order]
        self.at = np.searchsorted(f[order], np.arange(len(features) + 1)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {x: y for x, y in self.__dict__.items() if x not in ("matrix", "top")}

    def prepare(self) -> None:
        """The matrix and the block maxima; built where texts are scored, not broadcast."""
        if "matrix" in self.__dict__:
            return
        column, slot, w = self.common
        self.matrix = np.zeros((int(self.column.max()) + 1, len(self.example)))
        self.matrix[column, slot] = w
        self.top = self.matrix.reshape(-1, self.blocks, BLOCK).max(2)

    def nearest(self, of: np.ndarray, f: np.ndarray, w: np.ndarray, texts: int, fold: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """Per text the k examples of largest cosine: (cosine, slot). of, f, w: unit vectors of the texts.

        fold: for each text, examples whose number has this remainder are left out.
        """
        self.prepare()
        slots = len(self.example)
        column = self.column[f]
        some = column >= 0
        vectors = np.zeros((texts, len(self.matrix)))
        vectors[of[some], column[some]] = w[some]
        rest = np.zeros((texts, slots))
        of, f, w = of[~some], f[~some], w[~some]
        # Some texts at a time, so that no more than about half a million postings are spread out.
        many = np.cumsum(self.at[f + 1] - self.at[f])
        cuts = np.searchsorted(of, np.unique(np.r_[0, of[np.searchsorted(many, np.arange(POSTINGS, many[-1] if len(many) else 0, POSTINGS))], texts]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                first = int(of[lo])
                rows = int(of[hi - 1]) - first + 1
                at, n = spread(self.at[f[lo:hi]].astype(np.int64), self.at[f[lo:hi] + 1].astype(np.int64))
                place = np.repeat((of[lo:hi] - first) * slots, n) + self.number[at]
                rest[first : first + rows] = np.bincount(place, self.weight[at] * np.repeat(w[lo:hi], n), rows * slots).reshape(rows, slots)
        bound = vectors @ self.top + rest.reshape(texts, self.blocks, BLOCK).max(2)
        score = np.zeros((texts, slots))

        def finish(need: np.ndarray) -> None:
            for g, (lo, hi) in enumerate(zip(self.begin[:-1] * BLOCK, self.begin[1:] * BLOCK)):
                rows = np.flatnonzero(need[:, g])
                if len(rows):
                    score[rows, lo:hi] = rest[rows, lo:hi] + vectors[rows] @ self.matrix[:, lo:hi]

        kth = lambda: np.partition(score, -self.k, axis=1)[:, -self.k, None] if slots >= self.k else np.zeros((texts, 1))
        best = np.maximum.reduceat(bound, self.begin[:-1], axis=1)  # of a group's blocks
        if fold is None and best.shape[1] > FIRST:
            done = np.zeros(best.shape, bool)
            np.put_along_axis(done, np.argpartition(-best, FIRST - 1, axis=1)[:, :FIRST], True, axis=1)
            finish(done)
            finish(~done & (best > 0) & (best >= kth() - 1e-9))
        else:
            finish(np.ones(best.shape, bool))
        if fold is not None:
            score[(self.example % FOLDS)[None, :] == fold[:, None]] = 0
        np.round(score, 12, out=score)
        near = (score >= kth()) & (score > 0)
        out = []
        for row, use in zip(score, near):
            at = np.flatnonzero(use)
            at = at[np.lexsort((self.example[at], -row[at]))][: self.k]
            out.append(list(zip(row[at].tolist(), at.tolist())))
        return out

    def vote(self, best: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in best)
        return min(1.0, max(0.0, (self.mass * self.prior + sum(s * self.labels[i] for s, i in best)) / (self.mass + total)))

    def rated(self, votes: np.ndarray) -> np.ndarray:
        """Votes as rates of label 1."""
        return 1 / (1 + np.exp(-(self.slope * _logit(votes) + self.shift)))

    def calibrate(self, of: np.ndarray, f: np.ndarray, tf: np.ndarray, labels: np.ndarray, most: int) -> None:
        """Fit the map from votes to rates on the first `most` examples, half of each class where there are as many."""
        use = np.sort(np.concatenate([np.flatnonzero(labels == y)[: max(1, most // 2)] for y in (0, 1)]))
        votes, edges = [], np.searchsorted(of, np.arange(len(labels) + 1))
        for lo in range(0, len(use), LOT):
            part = use[lo : lo + LOT]
            at, n = spread(edges[part], edges[part + 1])
            votes += map(self.vote, self.nearest(*self.unit(np.repeat(np.arange(len(part)), n), f[at], tf[at], len(part)), len(part), part % FOLDS))
        x, y = _logit(np.array(votes)), labels[use].astype(np.float64)
        share = np.where(y == 1, self.prior / y.sum(), (1 - self.prior) / (1 - y).sum()) * len(y)
        slope, shift = 1.0, 0.0
        for _ in range(50):  # Newton; a weak pull towards the plain vote keeps separable classes finite
            p = 1 / (1 + np.exp(-(slope * x + shift)))
            g = np.array([(share * (y - p) * x).sum() - (slope - 1), (share * (y - p)).sum() - shift])
            v = share * p * (1 - p)
            h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
            step = np.linalg.solve(h, g)
            slope, shift = slope + float(np.clip(step[0], -1, 1)), shift + float(np.clip(step[1], -1, 1))
            if np.abs(step).max() < 1e-10:
                break
        if slope > 0:
            self.slope, self.shift = slope, shift

    def unit(self, of: np.ndarray, f: np.ndarray, tf: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.scale[f]
        w /= np.sqrt(np.bincount(of, w * w, texts))[of]
        return of, f, w

    def score(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
        """Scores and neighbours of texts."""
        rows, codes = document_features(buf, offs, self.stem)
        texts = len(offs) - 1
        scores, best = np.full(texts, self.prior), [[] for _ in range(texts)]
        if not len(self.features):
            return scores, best
        at = np.minimum(np.searchsorted(self.features, codes), len(self.features) - 1)
        held = self.features[at] == codes
        key, tf = np.unique(rows[held] * len(self.features) + at[held], return_counts=True)
        of, f = np.divmod(key, len(self.features))
        for lo in range(0, texts, LOT):
            a, z = np.searchsorted(of, (lo, lo + LOT))
            if a < z:
                n = min(LOT, texts - lo)
                best[lo : lo + n] = self.nearest(*self.unit(of[a:z] - lo, f[a:z], tf[a:z], n), n)
        some = np.array([bool(x) for x in best], bool)
        if some.any():
            scores[some] = self.rated(np.array([self.vote(x) for x in best if x]))
        return scores, best


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learnable: Column | None = None,
    per_class: int = 3_000,
    stem: int = 5,
    least_ratio: float = 20.0,
    least_odds: float = 8.0,
    least_documents: int = 3,
    boost: float = 10.0,
    k: int = 10,
    mass: float = 1.0,
    calibrated: int = 1_500,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Index:
    """An index over a bounded sample of the labelled rows; learnable: a condition on the id."""
    spark = docs.sparkSession
    short_batches(spark)
    known = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    if learnable is not None:
        known = known.where(learnable)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    rate = known.agg(F.avg("label")).first()[0] or 0.0
    by_hash = [F.xxhash64("id").asc(), F.col("id").asc()]
    parts = [known.where(F.col("label") == y).orderBy(*by_hash).limit(per_class) for y in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).join(sample, "id").select("id", "label", "text")

    kind = texts.schema["id"].dataType.simpleString()

    def features(batches):
        for b in batches:
            buf, offs = text_buffer(b.column(2))
            for lo, hi in chunks(offs):
                rows, codes = document_features(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], stem)
                order = np.lexsort((codes, rows))
                rows, codes = rows[order], codes[order]
                new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])]) if len(rows) else np.empty(0, np.int64)
                tf = np.diff(np.r_[new, len(rows)]).astype(np.int32)
                edges = np.searchsorted(rows[new], np.arange(hi - lo + 1)).tolist()
                some = np.flatnonzero(np.diff(edges))
                cut = lambda x: pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in some.tolist()], pa.binary())
                take = lambda i: b.column(i).slice(lo, hi - lo).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([take(0), take(1), cut(codes[new]), cut(tf)], names=["id", "label", "features", "tf"])

    vectors = texts.mapInArrow(frugal(features), f"id {kind}, label int, features binary, tf binary")
    # The words of at most 2 * per_class ids; repeated rows come once.
    got = vectors.dropDuplicates().withColumn("hash", F.xxhash64("id")).toArrow()
    marks, hashes = (got[x].to_numpy() for x in ("label", "hash"))
    none = np.empty(0, np.int64)
    ids = got["id"].combine_chunks()
    if pa.types.is_large_string(ids.type):
        ids = ids.cast(pa.string())
    if not (marks == 1).any() or not (marks == 0).any():
        return Index(none.astype(np.uint64), none, none, none, none, none, ids[:0], rate, k, mass, stem)
    named = ids.dictionary_encode().indices.to_numpy()
    order = np.lexsort((named, hashes))
    number = np.empty(len(named), np.int64)  # of the row's example
    number[order] = np.cumsum(np.r_[0, named[order][1:] != named[order][:-1]])
    flat, offs = text_buffer(got["features"])
    sizes = np.diff(offs) // 8
    codes, back = np.unique(flat.view(np.uint64), return_inverse=True)
    tf = text_buffer(got["tf"])[0].view(np.int32)
    del got, flat
    # An example's rows become one vector, with the largest term frequencies.
    back += np.repeat(number, sizes) * len(codes)
    order = np.argsort(back, kind="stable")
    key = back[order]
    del back
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tf = np.maximum.reduceat(tf[order], first).astype(np.float64)
    del order
    of, f = (x.astype(np.int32) for x in np.divmod(key[first], len(codes)))
    del key, first
    row = np.empty(number.max() + 1, np.int64)
    row[number] = np.arange(len(number))
    label, ids = marks[row], ids.take(pa.array(row))
    # Copies count once in document frequencies.
    edges = np.searchsorted(of, np.arange(len(row) + 1))
    seen: set = set()
    single = np.zeros(len(row), bool)
    for i, (y, lo, hi) in enumerate(zip(label.tolist(), edges[:-1], edges[1:])):
        name = (y, hashlib.sha256(f[lo:hi].tobytes() + tf[lo:hi].tobytes()).digest())
        single[i] = name not in seen
        seen.add(name)
    n1, n0 = (float((single & (label == y)).sum()) for y in (1, 0))
    a, b = (np.bincount(f[(single & (label == y))[of]], minlength=len(codes)).astype(np.float64) for y in (1, 0))
    whole = a + b
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.where(x > 0, e, 1)), 0.0)
    ratio = 2 * (
        part(a, whole * n1 / (n1 + n0)) + part(b, whole * n0 / (n1 + n0)) + part(n1 - a, (n1 + n0 - whole) * n1 / (n1 + n0)) + part(n0 - b, (n1 + n0 - whole) * n0 / (n1 + n0))
    )
    odds = np.abs(np.log(((a + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))))
    telling = (whole >= least_documents) & (ratio >= least_ratio) & (odds >= math.log(least_odds))
    scale = (np.log((1 + n1 + n0) / (1 + whole)) + 1) * np.where(telling, boost, 1.0)
    index = Index(codes, scale, of, f, tf, label, ids, float(rate), k, mass, stem)
    index.calibrate(of, f, tf, label, calibrated)
    del index.matrix, index.top, of, f, tf
    release_memory()
    return index


def with_toxicity(docs: DataFrame, index: Index, text_column: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a column struct(score, evidence: array of struct(doc_id, similarity, label))."""
    short_batches(docs.sparkSession)
    near = pa.struct([("doc_id", index.ids.type), ("similarity", pa.float64()), ("label", pa.int32())])
    kind = f"struct<score:double,evidence:array<struct<doc_id:{from_arrow_type(index.ids.type).simpleString()},similarity:double,label:int>>>"

    @F.arrow_udf(kind)
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for text in texts:
                buf, offs = text_buffer(text)
                scores, best = [np.empty(0)], []
                for lo, hi in chunks(offs, 1 << 19):
                    s, b = index.score(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                    scores.append(s)
                    best += b
                slots = np.array([i for x in best for _, i in x], np.int64)
                sims = pa.array([s for x in best for s, _ in x], pa.float64())
                example, label = (index.example[slots], index.labels[slots]) if len(slots) else (slots, slots)
                flat = pa.StructArray.from_arrays([index.ids.take(pa.array(example)), sims, pa.array(label.astype(np.int32))], fields=list(near))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, best)]), pa.int32()), flat)
                yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), lists], names=["score", "evidence"])
        finally:
            release_memory()

    return docs.withColumn(out, scored(F.col(text_column)))
