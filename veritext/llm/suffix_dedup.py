"""Repeated passages by an enhanced suffix array: maximal repeats of at least `min_len` bytes.

Texts are UTF-8 bytes. A string of min_len bytes that starts at two places of the corpus has the
same smallest `anchor`-byte window at both (the minimiser). So starts are dealt to groups by the
hash of their minimiser; the starts of one minimiser form a run, and the bytes they cover, at most
2 * min_len, are its segment. All suffixes that share min_len bytes or more meet in one group: the
common-prefix interval tree of the whole corpus, cut at depth min_len, falls apart into trees that
each lie in one group.

1. Minimiser hashes are counted; those that occur once are done with. A bitmap of bounded size
   tells the next scans which runs are worth sending (false hits only cost work).
2. Segments are sent by group, equal ones of a task once. A group of equal segments is one
   interval. Otherwise the suffix array of the group's segments is built, with the lengths of
   common prefixes, and a stack scan walks the intervals of depth min_len or more: an interval
   whose occurrences differ in the byte to their left is a maximal repeat, with all its
   occurrences. A run's first start counts as differing, as what is left of it lies elsewhere.
3. Groups of more than `hot` segments don't go to one task: equal segments are merged by
   counting, and the segments that stay alone, with one of each of the others, are split into their
   min_len-byte strings, each an interval of its own, again merged by counting.
4. Occurrences go back to their texts. Equal texts are one class throughout: a text that has a
   copy is covered as a whole, and a third of all rows being copies of one text adds one
   class.

Removed are all bytes that a repeat covers, judged on the input; the first place goes as well.
Null counts as empty. Texts below min_len bytes are never touched and touch nothing. Matches
never cross texts; overlapping places in one text count. Repeated rows are copies. Other columns
are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm import _bytes as B
from veritext.llm._shared import bitmap_of, bits_for, chunks, frugal, in_bitmap, short_batches, stored, text_buffer, with_last


def minimiser_runs(pre: np.ndarray, offs: np.ndarray, min_len: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, number of starts, hash of the minimiser) of each run."""
    n = len(pre) - 1
    none = np.empty(0, np.int64)
    if n < min_len:
        return none, none, none, np.empty(0, np.uint64)
    h = B.window_hash(pre, anchor)
    bits = np.uint64(max(22, len(h).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w = min_len - anchor + 1
    # Sliding minimum: running minima of blocks of w from the left and from the right.
    pad = -len(v) % w
    x = np.concatenate([v, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    left = np.minimum.accumulate(x, 1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - min_len + 1
    at = (np.minimum(right[:starts], left[w - 1 : w - 1 + starts]) & low).astype(np.int64)
    row = np.searchsorted(offs, np.arange(starts), "right") - 1
    inside = np.arange(starts) + min_len <= offs[row + 1]
    new = np.empty(starts, bool)
    new[0] = True
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & inside)
    # A run ends where the next begins or where its row has no more room.
    edge = np.flatnonzero(new)
    nxt = np.append(edge, starts)[np.searchsorted(edge, first, "right")]
    last = np.minimum(nxt, offs[row[first] + 1] - min_len + 1)
    return row[first], first, last - first, h[at[first]]


def _runs(batch: pa.RecordBatch, min_len: int, anchor: int, seen: set | None):
    """Runs of the texts of a batch (column 0), each distinct text of a task once."""
    buf, offs = text_buffer(batch.column(0))
    for lo, hi in chunks(offs):
        b, o = buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        names: list[bytes | None] = []
        for i in range(hi - lo):
            name = None
            if o[i + 1] - o[i] >= min_len:
                name = hashlib.sha256(b[o[i] : o[i + 1]]).digest()[:16]
                if seen is not None and name in seen:
                    name = None
                elif seen is not None:
                    seen.add(name)
            names.append(name)
        if any(x is not None for x in names):
            pre = B.prefix(b)
            row, first, count, key = minimiser_runs(pre, o, min_len, anchor)
            keep = np.array([x is not None for x in names])[row]
            yield b, o, pre, names, row[keep], first[keep], count[keep], key[keep]


def _key_counts(texts: DataFrame, min_len: int, anchor: int) -> DataFrame:
    def count(batches):
        seen: set = set()
        for batch in batches:
            for *_, key in _runs(batch, min_len, anchor, seen):
                k, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": pa.array(k.view(np.int64)), "n": pa.array(n, pa.int64())})

    return texts.mapInArrow(frugal(count), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _segment_codes(pre: np.ndarray, first: np.ndarray, count: np.ndarray, min_len: int) -> np.ndarray:
    return B.span_hash(pre, first, first + count + (min_len - 1))


def _both(key: np.ndarray, code: np.ndarray) -> np.ndarray:
    """One word for (key, code); SQL has the same."""
    return key ^ (code << np.uint64(1)) ^ (code >> np.uint64(63))


class Tree:
    """The common-prefix interval tree of some segments, cut at depth `min_len`.

    counts: how often each segment stands in the corpus. Suffixes are known by their place in one
    buffer; intervals are ranges of ranks. Only suffixes whose min_len bytes are repeated with
    different bytes to their left are sorted: all others lie inside a repeat that begins further left.
    """

    def __init__(self, segments: list[bytes], counts: np.ndarray, min_len: int):
        m = min_len
        size = np.array([len(s) for s in segments], np.int64)
        self.base = np.r_[0, np.cumsum(size)]
        self.raw = b"".join(segments)
        buf = np.frombuffer(self.raw, np.uint8)
        starts = size - m + 1
        of = np.repeat(np.arange(len(size)), starts)
        place = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + self.base[of]
        pre = B.prefix(buf)
        _, group, times = np.unique(B.span_hash(pre, place, place + m), return_inverse=True, return_counts=True)
        some = (times[group] > 1) | (counts[of] > 1)
        of, place, group = of[some].astype(np.int32), place[some], group[some]
        # What stands to the left; a run's first start has it elsewhere, so it counts as different.
        left = np.where(place == self.base[of], -1, buf[np.maximum(place - 1, 0)].astype(np.int16))
        low, high = np.full(len(times), 999, np.int16), np.full(len(times), -2, np.int16)
        np.minimum.at(low, group, left)
        np.maximum.at(high, group, left)
        pick = np.flatnonzero((low != high)[group] | (low == -1)[group])
        self.of, self.place, left, group = of[pick], place[pick], left[pick], group[pick]
        self.end = self.base[self.of + 1]
        self.twin = counts[self.of] > 1
        # Eight bytes from each place on, as one number in the order of the bytes.
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf)].copy().view(">u8").ravel().astype(np.uint64) if len(buf) else np.empty(0, np.uint64)
        self._sort(group, m)
        if len(self.place) and (self.depth[1:][group[1:] == group[:-1]] < m).any():  # one hash, other bytes
            self._sort(np.zeros(len(group), np.int64), 0)
        self.left = left[self.rank]
        self.min_len = m

    def _word(self, place: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The eight bytes at each place, zeros from its segment's end on."""
        rest = np.clip(end - place, 0, 8).astype(np.uint64)
        word = self.words[np.minimum(place, max(len(self.words) - 1, 0))] if len(self.words) else np.zeros(len(place), np.uint64)
        shift = (np.uint64(8) - rest) * np.uint64(8)
        return np.where(rest > 0, word >> np.minimum(shift, 63) << np.minimum(shift, 63), 0).astype(np.uint64)

    def _sort(self, group: np.ndarray, skip: int) -> None:
        """Order the suffixes by group and the bytes from `skip` on; depth: bytes shared with the one before."""
        place, end = self.place, self.end
        most = int((end - place).max(initial=0))
        order = np.argsort(end - place, kind="stable")
        for at in reversed(range(skip, most, 8)):
            order = order[np.argsort(self._word(place + at, end)[order], kind="stable")]
        order = order[np.argsort(group[order], kind="stable")]
        self.of, self.place, self.end, self.twin, self.rank = self.of[order], place[order], end[order], self.twin[order], order if skip else self.rank[order]
        a, b, x, y = self.place[:-1], self.place[1:], self.end[:-1], self.end[1:]
        depth, same = np.zeros(len(a), np.int64), np.flatnonzero(group[order][1:] == group[order][:-1])
        group[:] = group[order]
        at = 0
        while len(same):
            differ = self._word(a[same] + at, x[same]) ^ self._word(b[same] + at, y[same])
            shared = np.full(len(same), 8)
            some = differ > 0
            # The highest byte that differs; frexp gives the number of bits.
            shared[some] = (64 - np.frexp((differ[some] >> np.uint64(11) << np.uint64(11) | (differ[some] < 2048) * differ[some]).astype(np.float64))[1]) // 8
            room = np.minimum(x[same] - a[same], y[same] - b[same]) - at
            depth[same] += np.minimum(shared, np.maximum(room, 0))
            same = same[(~some) & (room > 8)]
            at += 8
        self.depth = np.r_[0, depth] if len(place) else depth

    def intervals(self) -> list[tuple[int, int, int]]:
        """(length, first rank, last rank) of each left-diverse interval, inner ones after those around them."""
        out: list[tuple[int, int, int]] = []
        turns = np.cumsum(np.r_[0, self.left[1:] != self.left[:-1]]).tolist() if len(self.left) else []
        left, m = self.left.tolist(), self.min_len
        stack: list[tuple[int, int]] = []  # depth, first rank
        for i, depth in enumerate([*self.depth[1:].tolist(), 0] if len(left) else []):
            lo = i
            while stack and stack[-1][0] > depth:
                d, lo = stack.pop()
                if turns[i] > turns[lo] or left[lo] == -1:
                    out.append((d, lo, i))
            if depth >= m and (not stack or stack[-1][0] < depth):
                stack.append((depth, lo))
        out.sort()
        return out

    def groups(self):
        """(length, ranks) of each maximal repeat; a rank of a segment that has equals stands for all of them."""
        for depth, lo, hi in self.intervals():
            yield depth, range(lo, hi + 1)
        for r in np.flatnonzero(self.twin).tolist():
            yield int(self.end[r] - self.place[r]), range(r, r + 1)

    def covered(self) -> list[list[list[int]]]:
        """Per segment: the byte ranges that its maximal repeats cover."""
        cover = np.zeros(len(self.place), np.int64)
        for depth, lo, hi in self.intervals():  # deeper ones lie inside and come later
            cover[lo : hi + 1] = depth
        cover[self.twin] = (self.end - self.place)[self.twin]
        out: list[list[list[int]]] = [[] for _ in range(len(self.base) - 1)]
        use = np.flatnonzero(cover)
        use = use[np.argsort(self.place[use], kind="stable")]
        of, lo = self.of[use], self.place[use]
        reach = np.maximum.accumulate(lo + cover[use]) if len(use) else lo
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (lo[1:] > reach[:-1])]) if len(use) else use
        for k, first in enumerate(new.tolist()):
            last = new[k + 1] - 1 if k + 1 < len(new) else len(use) - 1
            s = int(of[first])
            out[s].append([int(lo[first] - self.base[s]), int(reach[last] - self.base[s])])
        return out


def merged(ranges) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


_RANGES = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _ranges(x) -> pa.Array:
    return pa.array([[{"lo": a, "hi": b} for a, b in r] for r in x], _RANGES)


def _repeated_runs(texts: DataFrame, min_len: int, anchor: int, repeated: np.ndarray, hot: np.ndarray | None) -> DataFrame:
    """All runs that may be repeated, in one scan; a table of two kinds of rows.

    Places: (key, code, name of the text, first start, bytes). Distinct segments of a task:
    (key, code, n, segment); hot ones without their bytes.
    """

    def send(batches):
        seen: set = set()
        held: dict[tuple[int, int], list] = {}
        weight = 0
        for batch in batches:
            for b, o, pre, names, row, first, count, key in _runs(batch, min_len, anchor, seen):
                keep = np.flatnonzero(in_bitmap(repeated, key))
                row, first, count, key = row[keep], first[keep], count[keep], key[keep]
                code = _segment_codes(pre, first, count, min_len)
                none = lambda t, n=len(keep): pa.nulls(n, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)), pa.array(code.view(np.int64)), pa.array([names[r] for r in row.tolist()], pa.binary()),
                        pa.array(first - o[row], pa.int64()), pa.array(count + (min_len - 1), pa.int64()), none(pa.int64()), none(pa.binary()),
                    ],
                    names=_RUN_NAMES,
                )
                warm = in_bitmap(hot, key) if hot is not None else np.zeros(len(key), bool)
                raw = b.tobytes()
                for k, c, lo, n, x in zip(key.view(np.int64).tolist(), code.view(np.int64).tolist(), first.tolist(), count.tolist(), warm.tolist()):
                    have = held.get((k, c))
                    if have is None:
                        segment = None if x else raw[lo : lo + n + min_len - 1]
                        held[k, c] = [1, segment]
                        weight += 100 + (0 if x else len(segment))
                    else:
                        have[0] += 1
                if weight > 16 << 20:
                    yield _held(held)
                    held, weight = {}, 0
        if held:
            yield _held(held)

    return stored(texts.mapInArrow(frugal(send), "key bigint, code bigint, name binary, first bigint, size bigint, n bigint, segment binary"))


_RUN_NAMES = ["key", "code", "name", "first", "size", "n", "segment"]


def _held(held: dict) -> pa.RecordBatch:
    none = lambda t: pa.nulls(len(held), t)
    key, code = (pa.array([k[i] for k in held], pa.int64()) for i in (0, 1))
    n, segment = (pa.array([x[i] for x in held.values()], t) for i, t in ((0, pa.int64()), (1, pa.binary())))
    return pa.RecordBatch.from_arrays([key, code, none(pa.binary()), none(pa.int64()), none(pa.int64()), n, segment], names=_RUN_NAMES)


def _trees(segments: DataFrame, min_len: int, listed: bool = False) -> DataFrame:
    """(key, code, ranges): what is covered of the segments of groups that one task can hold;
    listed: (key, code, repeat, length, begin) of each place of each maximal repeat instead."""

    def walk(batches):
        rest: list[tuple] = []  # distinct segments in order of (key, code)
        for last, b in with_last(batches):
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if rest and rest[-1][:2] == row[:2] and rest[-1][3] == row[3]:
                    rest[-1] = (*row[:2], rest[-1][2] + row[2], rest[-1][3])
                else:
                    rest.append(row)
            weight = sum(len(r[3]) for r in rest)
            if weight < 4 << 20 and not last:
                continue
            cut = len(rest)
            if not last:  # the last group may go on
                while cut and rest[cut - 1][0] == rest[-1][0]:
                    cut -= 1
            done, rest = rest[:cut], rest[cut:]
            yield from grow(done)

    def told(rows):
        """Maximal repeats of some groups: a row for each segment and place."""
        tree = Tree([r[3] for r in rows], np.array([r[2] for r in rows]), min_len)
        out: list[list] = [[], [], [], [], []]
        for depth, ranks in tree.groups():
            first = int(tree.place[ranks[0]])
            name = hashlib.sha256(tree.raw[first : first + depth]).digest()[:16]
            for r in ranks:
                of = int(tree.of[r])
                for column, x in zip(out, (rows[of][0], rows[of][1], name, depth, int(tree.place[r] - tree.base[of]))):
                    column.append(x)
        if out[0]:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["key", "code", "repeat", "length", "begin"])

    def grow(rows):
        if listed:
            yield from told(rows)
            return
        keys, codes, ranges, lot, weight = [], [], [], [], 0
        edges = [i for i in range(len(rows)) if not i or rows[i][0] != rows[i - 1][0]] + [len(rows)]
        for i, j in zip(edges[:-1], edges[1:]):
            if j - i == 1:  # one distinct segment: an interval if it occurs again
                if rows[i][2] > 1:
                    keys.append(rows[i][0])
                    codes.append(rows[i][1])
                    ranges.append([[0, len(rows[i][3])]])
            else:
                lot += rows[i:j]
                weight += sum(len(r[3]) for r in rows[i:j])
            if lot and (weight > 1 << 18 or j == len(rows)):
                for r, x in zip(lot, Tree([r[3] for r in lot], np.array([r[2] for r in lot]), min_len).covered()):
                    if x:
                        keys.append(r[0])
                        codes.append(r[1])
                        ranges.append(x)
                lot, weight = [], 0
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codes, pa.int64()), _ranges(ranges)], names=["key", "code", "ranges"])

    sorted_ = segments.repartition("key").sortWithinPartitions("key", "code")
    if listed:
        return sorted_.mapInArrow(frugal(walk), "key bigint, code bigint, repeat binary, length int, begin int")
    return sorted_.mapInArrow(frugal(walk), "key bigint, code bigint, ranges array<struct<lo:int,hi:int>>")


def _hot_strings(texts: DataFrame, min_len: int, anchor: int, repeated: np.ndarray, hot: np.ndarray, alone: np.ndarray) -> DataFrame:
    """min_len-byte strings of hot groups: (key, code, name, first).

    All strings of segments that stand alone, with the text's name; of the other segments, which
    occur twice or more, each distinct one of a task once and without a name.
    """

    def send(batches):
        seen: set = set()
        known: set = set()
        for batch in batches:
            for _, o, pre, names, row, first, count, key in _runs(batch, min_len, anchor, seen):
                keep = np.flatnonzero(in_bitmap(hot, key) & in_bitmap(repeated, key))
                row, first, count, key = row[keep], first[keep], count[keep], key[keep]
                code = _segment_codes(pre, first, count, min_len)
                both = _both(key, code)
                lone = in_bitmap(alone, both)
                new = np.zeros(len(key), bool)
                for i, x in enumerate(both.tolist()):
                    if x not in known:
                        known.add(x)
                        new[i] = True
                use = np.flatnonzero(lone | new)
                if not len(use):
                    continue
                of = np.repeat(use, count[use])
                start = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count[use]) - count[use], count[use])
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": pa.array(B.span_hash(pre, start, start + min_len).view(np.int64)),
                        "code": pa.array(B.span_hash(pre, start, start + min_len // 2).view(np.int64)),
                        "name": pa.array([names[r] if y else None for r, y in zip(row[of].tolist(), lone[of].tolist())], pa.binary()),
                        "first": pa.array(start - o[row[of]], pa.int64()),
                    }
                )

    return texts.mapInArrow(frugal(send), "key bigint, code bigint, name binary, first bigint")


def repeated_spans(texts: DataFrame, min_len: int, anchor: int, hot: int) -> DataFrame:
    """(name, lo, hi): covered byte ranges, not yet merged; name: 16 bytes of the text's sha256."""
    counts = stored(_key_counts(texts, min_len, anchor))
    keys = counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > hot).alias("hot")).first()
    repeated = bitmap_of(counts, "key", bits_for(keys["n"]))
    warm = bitmap_of(counts.where(F.col("n") > hot), "key", bits_for(keys["hot"])) if keys["hot"] else None
    runs = _repeated_runs(texts, min_len, anchor, repeated, warm)
    segments, places = runs.where("n IS NOT NULL").select("key", "code", "n", "segment"), runs.where("name IS NOT NULL").select("key", "code", "name", "first", "size")
    trees, extra = _trees(segments.where("segment IS NOT NULL"), min_len), None
    if warm is not None:
        large = stored(segments.where("segment IS NULL").groupBy("key", "code").agg(F.sum("n").alias("n")))
        whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(-1).alias("hi")))
        trees = trees.unionByName(large.where("n > 1").select("key", "code", whole.alias("ranges")))
        lone = large.where("n = 1").select(F.expr("key ^ shiftleft(code, 1) ^ shiftrightunsigned(code, 63)").alias("both"))
        alone = bitmap_of(lone, "both", bits_for(lone.count()))
        strings = stored(_hot_strings(texts, min_len, anchor, repeated, warm, alone))
        # Repeated: in a segment that occurs again, or in two places of lone segments.
        many = strings.groupBy("key", "code").agg(F.count("name").alias("lone"), F.count(F.lit(1)).alias("all"))
        many = many.where("lone > 1 OR all > lone").select("key", "code")
        extra = strings.where("name IS NOT NULL").join(many, ["key", "code"])
        extra = extra.select("name", F.col("first").alias("lo"), (F.col("first") + min_len).alias("hi"))
    met = places.join(trees, ["key", "code"]).select("name", "first", "size", F.explode("ranges").alias("r"))
    end = F.when(F.col("r.hi") < 0, F.col("size")).otherwise(F.col("r.hi"))
    spans = met.select("name", (F.col("first") + F.col("r.lo")).alias("lo"), (F.col("first") + end).alias("hi"))
    return spans if extra is None else spans.unionByName(extra)


def repeat_groups(docs: DataFrame, min_len: int = 200, anchor: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The maximal repeats themselves: (repeat, length, doc_id, start), a row for each place of each.

    repeat: 16 bytes of the passage's sha256. Passages longer than a segment come as several that
    overlap. All segments of a minimiser meet in one task here, whatever their number; remove_repeats()
    has no need of that.
    """
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit(""))
    texts = docs.select(text.alias("text"))
    counts = stored(_key_counts(texts, min_len, anchor))
    repeated = bitmap_of(counts, "key", bits_for(counts.count()))
    runs = _repeated_runs(texts, min_len, anchor, repeated, None)
    trees = _trees(runs.where("n IS NOT NULL").select("key", "code", "n", "segment"), min_len, listed=True)
    places = runs.where("name IS NOT NULL").select("key", "code", "name", "first").join(trees, ["key", "code"])
    found = places.select("name", "repeat", "length", (F.col("first") + F.col("begin")).alias("start")).distinct()
    rows = docs.select(F.col(id_column).alias("doc_id"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("name"))
    return found.join(rows, "name").select("repeat", "length", "doc_id", "start")


def remove_repeats(
    docs: DataFrame, min_len: int = 200, anchor: int = 64, hot: int = 20_000, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (merged byte ranges)."""
    spark = docs.sparkSession
    short_batches(spark)
    text = F.coalesce(F.col(text_column), F.lit(""))
    sha = F.sha2(text, 256)
    rows = docs.select(F.col(id_column).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha"))
    rows = stored(rows.withColumn("name", F.substring(F.unhex("sha"), 1, 16)))
    texts = docs.select(text.alias("text"))
    spans = stored(repeated_spans(texts, min_len, anchor, hot).groupBy("name").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    codes = spans.select(F.expr("cast(conv(hex(substring(name, 1, 8)), 16, -10) as bigint)").alias("c"))
    wanted = bitmap_of(codes, "c", bits_for(codes.count()))

    def touched(batches):
        """Texts that may hold spans, each distinct one of a task once."""
        seen: set = set()
        for batch in batches:
            buf, offs = text_buffer(batch.column(0))
            names = [hashlib.sha256(buf[a:b]).digest()[:16] for a, b in zip(offs[:-1], offs[1:])]
            may = in_bitmap(wanted, np.array([int.from_bytes(x[:8], "big") for x in names], np.uint64))
            use = [i for i in np.flatnonzero(may).tolist() if names[i] not in seen and not seen.add(names[i])]
            if use:
                yield pa.RecordBatch.from_pydict({"name": pa.array([names[i] for i in use], pa.binary()), "text": pa.array([buf[offs[i] : offs[i + 1]].tobytes() for i in use], pa.binary())})

    def cut(batches):
        for batch in batches:
            out = {"name": [], "n_removed": [], "n_spans": [], "kept": [], "spans": []}
            for name, raw, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                runs = merged((x["lo"], x["hi"]) for x in found)
                h, at = hashlib.sha256(), 0
                for lo, hi in runs:
                    h.update(raw[at:lo])
                    at = hi
                h.update(raw[at:])
                out["name"].append(name)
                out["n_removed"].append(sum(hi - lo for lo, hi in runs))
                out["n_spans"].append(len(runs))
                out["kept"].append(h.hexdigest())
                out["spans"].append([{"lo": lo, "hi": hi} for lo, hi in runs])
            kinds = {"name": pa.binary(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string(), "spans": _RANGES}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    held = texts.mapInArrow(frugal(touched), "name binary, text binary")
    held = held.join(spans, "name").select("name", "text", "spans")
    done = held.mapInArrow(frugal(cut), "name binary, n_removed bigint, n_spans bigint, kept string, spans array<struct<lo:int,hi:int>>")
    done = done.dropDuplicates(["name"])
    copies = rows.where(F.col("n_bytes") >= min_len).groupBy("name").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = copies.join(done, "name", "full")
    twin = F.col("copies").isNotNull()
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    all_ = F.array(F.struct(F.lit(0).alias("lo"), F.col("n_bytes").cast("int").alias("hi")))
    return rows.join(found, "name", "left").select(
        "doc_id",
        "n_bytes",
        F.when(twin, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(twin, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twin, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(twin, all_).otherwise(F.coalesce("spans", none)).alias("spans"),
    )
