"""Near duplicates: an n-gram Jaccard join by rare-first prefix filtering.

A document's set holds the hashes of its distinct runs of `size` words (words between white space,
A-Z in lower case); with fewer words, but not none, the whole sequence is the one run. Documents
with one set form a class, known by a hash of the set; only classes are joined. Two classes link
when 100 * intersection >= percent * union.

1. Frequencies. A count sketch (2**sketch_bits counters at most, summed over all documents) gives
   each n-gram an upper bound of its frequency. N-grams are ordered by it, rare first, then by
   hash. Any total order is right; this one keeps common n-grams out of prefixes. Tasks send their
   counts sparsely, so that the sketch costs bytes in proportion to the n-grams counted.
2. Prefix filter. Two linked sets of sizes a and b share one of the first
   a - ceil(t * a) + 1 n-grams of each in that order. These prefix entries are packed by hash
   range (eight bytes an entry) and shuffled once; only n-grams that two classes share survive.
   N-grams that the sketch calls common are split further, by the class's hash. Entries of one
   n-gram in one task come from distinct classes, so a group of copies sends its entries once a task.
3. Candidates. Where the entries of an n-gram group meet, every member is paired with one pivot:
   groups yield as many pairs as members, not all pairs. Pairs pass the length filter, the
   positional filter and the suffix filter (parities of both sets' n-grams in equal ranges of hash
   space bound the overlap). The texts of what is left meet in stars, a pivot with at most some
   dozens of members, and each pair is verified once on the whole sets.
4. Components of the verified links are found by joins. All members have met their pivot, so that
   only groups of three or more go on, without it; large ones that still hold several components
   get other pivots, once more.
5. What may be left are links inside a group whose members lie in different components. All such
   pairs pass the filters, in blocks of `block` members, and each member that may link comes out
   with one other that it hangs together with. These rows fall into families, and the texts of a family's members
   meet in a grid of blocks, where each pair of different components is verified once. No link
   is lost, no task holds a whole group, and rows stay in proportion to members.

What is broadcast is bounded: the sketch, one byte a counter (16 MB), and bitmaps (32 MB) that tell which
documents' texts have to be sent at all; when a bitmap is full, more texts travel and the result is
the same. Classes are named by 64 bits of their n-grams' hashes; sets that share a name are told
apart by 64 further bits, and such names (a handful in 10**10 documents) are given up for those.

Long texts: a text is handled as a whole, in memory that follows the longest one.
Null, empty and wordless texts have the empty set, link with nothing and are their own component.
Ties: a component's id is its smallest doc_id; null ids get a component of their own, null.
Repeated rows fall into one class. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritext.llm import _bytes as B
from veritext.llm._shared import _pack, _unpack, bitmap_of, bits_for, chunks, discard, fresh, frugal, in_bitmap, maybe_in, own, short_batches, stored, text_buffer, with_last

#: Members that meet one copy of their pivot's text.
STAR = 64
SLICES = 16


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all rows, one after the other, and where each row begins."""
    low = B.LOWER[buf]
    start, end, first = B.words(low, offs, B.SPACED)
    codes = B.span_hash(B.prefix(low), start, end)
    n = np.diff(first)
    g = B.grams(codes, size)
    ok = B.within(first, size)
    rows = B.row_of(first)[: len(g)][ok]
    g = g[ok]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        extra = np.array([B.grams(codes[first[r] : first[r + 1]], int(n[r]))[0] for r in few], np.uint64)
        rows, g = np.r_[rows, few], np.r_[g, extra]
        order = np.argsort(rows, kind="stable")
        rows, g = rows[order], g[order]
    at = np.searchsorted(rows, np.arange(len(offs)))
    parts, begin = [], np.zeros(len(offs), np.int64)
    for r in range(len(offs) - 1):
        if at[r] < at[r + 1]:
            parts.append(np.unique(g[at[r] : at[r + 1]]))
            begin[r + 1] = len(parts[-1])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(begin)


_NAME, _OTHER = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


def class_of(sets: np.ndarray, begin: np.ndarray, salt: np.uint64 = _NAME) -> np.ndarray:
    """A 64-bit name of each row's set; 0 for the empty one."""
    out = np.zeros(len(begin) - 1, np.uint64)
    some = np.diff(begin) > 0
    if len(sets):
        x = np.add.reduceat(B.mix(sets ^ salt), begin[:-1][some])
        out[some] = B.mix(x + np.diff(begin)[some].astype(np.uint64))
        out[out == 0] = some[out == 0]
    return out


class Sets:
    """Cuts texts into n-gram sets and names them. twins: names that different sets share."""

    def __init__(self, size: int, name_bits: int = 64, twins: tuple[int, ...] = ()):
        self.size, self.mask = size, np.uint64((1 << name_bits) - 1)
        self.twins = np.sort(np.array(twins, np.int64).view(np.uint64))

    def names(self, sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = class_of(sets, begin) & self.mask
        out[(out == 0) & (np.diff(begin) > 0)] = 1
        if len(self.twins) and (at := np.isin(out, self.twins)).any():
            out[at] = class_of(sets, begin, _OTHER)[at]
        return out

    def of(self, batch: pa.RecordBatch, column: int):
        """(first row, last row, sets, where each begins, names) of parts of a batch of texts."""
        buf, offs = text_buffer(batch.column(column))
        for lo, hi in chunks(offs):
            sets, begin = shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], self.size)
            yield lo, hi, sets, begin, self.names(sets, begin)


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (n * percent + 99) // 100 + 1


def _distinct(seen: set, names: np.ndarray) -> list[int]:
    """Rows whose class is neither empty nor seen before."""
    out = []
    for r, c in enumerate(names.tolist()):
        if c and c not in seen:
            seen.add(c)
            out.append(r)
    return out


def fold(s: np.ndarray) -> bytes:
    """Parities of the numbers of a set's n-grams in equal ranges of hash space, one to two bits an n-gram."""
    wide = max(3, len(s).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(64 - wide)).astype(np.int64), minlength=1 << wide) & 1).tobytes()


def may_link(x: list[bytes], y: list[bytes], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The suffix filter on pairs of folded sets of sizes a and b.

    A range whose parities differ holds an n-gram that only one set has; their number bounds
    the overlap. Folds of different widths are compared at the smaller one.
    """
    ok = np.minimum(a, b) * 100 >= np.maximum(a, b) * percent
    wide = np.minimum([len(p) for p in x], [len(p) for p in y]) if len(x) else np.empty(0, np.int64)
    for w in np.unique(wide[ok]).tolist():
        at = np.flatnonzero(ok & (wide == w))
        step = max(1, (8 << 20) // w)
        for lo in range(0, len(at), step):
            part = at[lo : lo + step]
            u, v = (_at_width([z[i] for i in part], w) for z in (x, y))
            apart = np.bitwise_count(u ^ v).sum(1, dtype=np.int64)
            both = a[part] + b[part]
            shared = (both - apart) // 2
            ok[part] = 100 * shared >= percent * (both - shared)
    return ok


def _at_width(folds: list[bytes], w: int) -> np.ndarray:
    out = np.zeros((len(folds), w), np.uint8)
    sizes = np.array([len(f) for f in folds])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        m = np.frombuffer(b"".join(folds[i] for i in at), np.uint8).reshape(len(at), size)
        if size > w:  # neighbouring ranges become one; their parities add
            bits = np.unpackbits(m, axis=1).reshape(len(at), w * 8, size // w)
            m = np.packbits(np.bitwise_xor.reduce(bits, axis=2), axis=1)
        out[at] = m
    return out


_SCAN = "n bigint, cls bigint, other bigint, fold binary, slice int, counts binary"


def _scanned(docs: DataFrame, id_column: str, text_column: str, cut: Sets, bits: int) -> DataFrame:
    """One scan: a row (id, n, cls, other) per document, a row (cls, other, n, fold) per distinct class
    of a task, and the task's share of the count sketch in slices."""
    per = 1 << bits - 4

    def counted(slots: list):
        """Counts of a few million n-grams; slots that none of them has cost next to nothing."""
        every = np.concatenate(slots)
        every.sort()
        edges = np.searchsorted(every, np.arange(SLICES + 1) * per)
        for s, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            if lo < hi:
                yield s, np.minimum(np.bincount(every[lo:hi] - np.uint32(s * per), minlength=per), 65535).astype(np.uint16)

    def run(batches):
        seen: set = set()
        slots, waiting, kind = [], 0, None
        for b in batches:
            kind = b.schema.field(1).type
            for lo, hi, sets, begin, names in cut.of(b, 0):
                other = class_of(sets, begin, _OTHER)
                n, new = np.diff(begin), _distinct(seen, np.where(names > 0, names ^ B.mix(other), 0))
                yield batch(kind, hi - lo, b.column(1).slice(lo, hi - lo), n, names, other, None, None, None)
                if new:
                    fresh_ = np.zeros(hi - lo, bool)
                    fresh_[new] = True
                    own_ = sets if len(new) == hi - lo else sets[np.repeat(fresh_, n)]
                    slots.append((own_ & np.uint64((1 << bits) - 1)).astype(np.uint32))
                    waiting += len(own_)
                    folds = [fold(sets[begin[r] : begin[r + 1]]) for r in new]
                    yield batch(kind, len(new), None, n[new], names[new], other[new], folds, None, None)
            if waiting > 1 << 22:
                for s, x in counted(slots):
                    yield batch(kind, 1, None, None, None, None, None, [s], [_pack(x.tobytes())])
                slots, waiting = [], 0
        if waiting:
            for s, x in counted(slots):
                yield batch(kind, 1, None, None, None, None, None, [s], [_pack(x.tobytes())])

    def batch(kind, rows, ids, n, cls, other, folds, slice_, counts):
        col = lambda x, t: pa.nulls(rows, t) if x is None else pa.array(x, t)
        named = lambda x: col(None if x is None else x.view(np.int64), pa.int64())
        out = {"id": pa.nulls(rows, kind) if ids is None else ids, "n": col(n, pa.int64()), "cls": named(cls), "other": named(other)}
        return pa.RecordBatch.from_pydict(out | {"fold": col(folds, pa.binary()), "slice": col(slice_, pa.int32()), "counts": col(counts, pa.binary())})

    rows = docs.select(F.col(text_column).alias("text"), F.col(id_column).alias("id"))
    return stored(rows.mapInArrow(frugal(run), f"id {rows.schema['id'].dataType.simpleString()}, " + _SCAN))


def _twins(scan: DataFrame) -> tuple[int, ...]:
    """Names that different sets share: as good as none, however many documents there are."""
    same = scan.where("fold IS NOT NULL").groupBy("cls").agg(F.min("other").alias("x"), F.max("other").alias("y"))
    return tuple(r["cls"] for r in same.where("x <> y").select("cls").collect())


def _levels(scan: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """The summed sketch on a fine logarithmic scale, and the number of n-grams.

    Slices are summed in two steps, so that a task reads about the square root of the shares.
    """
    per = 1 << bits - 4

    def summed(kind: type, last: bool):
        def add(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    held.setdefault(s, np.zeros(per, np.uint32))
                    held[s] += np.frombuffer(_unpack(x), kind)
            for s, x in held.items():
                out = np.minimum(np.log2(x + 1.0) * 8, 255).astype(np.uint8) if last else x
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "counts": pa.array([_pack(out.tobytes())], pa.binary()), "total": pa.array([int(x.sum())], pa.int64())})

        return frugal(add)

    shares = scan.where("slice IS NOT NULL").select("slice", "counts")
    schema, parts = "slice int, counts binary, total bigint", max(1, math.isqrt(shares.count() // SLICES))
    dealt = shares.repartition(SLICES * parts, "slice", F.pmod(F.xxhash64("counts"), F.lit(parts)))
    got = dealt.mapInArrow(summed(np.uint16, False), schema).select("slice", "counts").repartitionById(SLICES, F.col("slice")).mapInArrow(summed(np.uint32, True), schema).collect()
    level, total = np.zeros(1 << bits, np.uint8), 0
    for r in got:
        level[r["slice"] * per : (r["slice"] + 1) * per] = np.frombuffer(_unpack(bytes(r["counts"])), np.uint8)
        total += r["total"]
    # A small corpus needs no more than some counters an n-gram.
    keep = min(bits, max(16, total.bit_length() + 2))
    return level.reshape(-1, 1 << keep).max(0), total


_HEAVY, _POS = 1 << 15, (1 << 15) - 1
#: Prefix entries that meet in one task, and that a task packs at once.
PER_TASK, AT_ONCE = 1_500_000, 2_000_000


class Entries:
    """Prefix entries of many classes, packed by range of the n-gram hash.

    A payload names its classes once; n-grams keep 48 bits, as differences to the one before.
    """

    def __init__(self, level: np.ndarray, ranges: int, split: int):
        self.level, self.ranges = level, ranges
        # Parts of an n-gram's group by the level of its counter: parts of about `split` members.
        self.parts = np.maximum(np.ceil((2.0 ** (np.arange(256) / 8) - 1) / split), 1).astype(np.int64)

    def rank(self, grams: np.ndarray) -> np.ndarray:
        return self.level[(grams & np.uint64(len(self.level) - 1)).astype(np.int64)]

    def packed(self, held: list) -> pa.RecordBatch:
        """held: (n-grams, class, size of its set) of each class, n-grams in prefix order."""
        k = np.array([len(h[0]) for h in held])
        gram = np.concatenate([h[0] for h in held])
        name, n = (np.repeat(np.array([h[i] for h in held], t), k) for i, t in ((1, np.uint64), (2, np.uint32)))
        pos = np.minimum(np.arange(len(gram)) - np.repeat(np.cumsum(k) - k, k), _POS).astype(np.uint16)
        parts = self.parts[self.rank(gram)]
        where = ((gram >> np.uint64(33)) * np.uint64(self.ranges) >> np.uint64(31)).astype(np.int64)
        heavy = parts > 1
        if heavy.any():
            pos[heavy] |= np.uint16(_HEAVY)
            where[heavy] += self.ranges * (1 + (B.mix(name[heavy]) % parts[heavy].astype(np.uint64)).astype(np.int64))
        order = np.lexsort((gram, where))
        gram, name, n, pos, where = gram[order] >> np.uint64(16), name[order], n[order], pos[order], where[order]
        edges = np.flatnonzero(np.r_[True, where[1:] != where[:-1], True])
        loads = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            who, index = np.unique(name[lo:hi], return_inverse=True)
            sizes = np.zeros(len(who), np.uint32)
            sizes[index] = n[lo:hi]
            step = np.diff(gram[lo:hi])
            wide, many = bool(len(step)) and int(step.max()) >> 32 > 0, len(who) > 65536
            head = np.array([len(who), hi - lo, wide + 2 * many], np.uint32).tobytes() + gram[lo : lo + 1].tobytes()
            loads.append(head + who.tobytes() + sizes.tobytes() + step.astype(np.uint64 if wide else np.uint32).tobytes() + index.astype(np.uint32 if many else np.uint16).tobytes() + pos[lo:hi].tobytes())
        return pa.RecordBatch.from_pydict({"range": pa.array(where[edges[:-1]], pa.int64()), "payload": pa.array(loads, pa.binary())})

    @staticmethod
    def unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
        m, k, flags = np.frombuffer(raw, np.uint32, 3).tolist()
        at = 12

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(raw, kind, count, at)
            at += x.nbytes
            return x

        first, who, sizes = take(np.uint64, 1), take(np.uint64, m), take(np.uint32, m)
        step = take(np.uint64 if flags & 1 else np.uint32, k - 1)
        index, pos = take(np.uint32 if flags & 2 else np.uint16, k), take(np.uint16, k)
        return np.cumsum(np.r_[first, step.astype(np.uint64)], dtype=np.uint64), who[index], sizes[index], pos


def _entries(texts: DataFrame, cut: Sets, percent: int, entries: Entries) -> DataFrame:
    """Prefix entries packed by range of the n-gram hash: (range, payload)."""

    def pack(batches):
        seen: set = set()
        held, count = [], 0
        for b in batches:
            for _, _, sets, begin, names in cut.of(b, 0):
                rank = entries.rank(sets)
                for r in _distinct(seen, names):
                    lo, hi = begin[r], begin[r + 1]
                    p = int(prefix_size(np.int64(hi - lo), percent))
                    # Hashes are sorted, so a stable selection by rank is the order (rank, hash).
                    held.append((sets[lo:hi][np.argsort(rank[lo:hi], kind="stable")[:p]], names[r], hi - lo))
                    count += p
                if count > AT_ONCE:
                    yield entries.packed(held)
                    held, count = [], 0
        if held:
            yield entries.packed(held)

    return texts.mapInArrow(frugal(pack), "range bigint, payload binary")


_GROUPS = "gram bigint, cls bigint, n int, pos int, pivot bigint, fits boolean, k int, parted boolean"


def _shared_grams(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of n-grams that two or more classes have in their prefixes, with the group's pivot,
    whether the pair passes the length and the positional filter, the group's size, and whether it
    is a part of a larger one.

    Rows are sorted by range; one range is looked at at a time.
    """

    def shared(loads: list):
        gram, name, n, pos = (np.concatenate(x) for x in zip(*map(Entries.unpacked, loads)))
        order = np.lexsort((name, gram))
        gram, name, n, pos = gram[order], name[order], n[order].astype(np.int64), pos[order].astype(np.int64)
        new = np.r_[True, (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])]
        gram, name, n, pos = gram[new], name[new], n[new], pos[new]
        edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        k = np.diff(np.r_[edge, len(gram)])
        # A common n-gram's group has other parts elsewhere.
        parted = pos & _HEAVY > 0
        keep = (np.repeat(k, k) > 1) | parted
        if not keep.any():
            return
        # Groups agree on their pivots as far as they can.
        order = B.mix(name)
        at = np.flatnonzero(order == np.repeat(np.maximum.reduceat(order, edge), k))
        pivot = np.repeat(at, k)
        pos &= _POS
        m, q = n[pivot], pos[pivot]
        need = -(-(n + m) * percent // (100 + percent))
        fits = (pivot != np.arange(len(gram))) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (np.minimum(n - pos, m - q) >= need - np.minimum(pos, q))
        k, pivot = np.repeat(k, k), name[pivot]
        some = np.flatnonzero(keep)
        for lo in range(0, len(some), 50_000):
            s = some[lo : lo + 50_000]
            whole = lambda x: pa.array(x[s].view(np.int64))
            small = lambda x: pa.array(x[s].astype(np.int32))
            yield pa.RecordBatch.from_pydict({"gram": whole(gram), "cls": whole(name), "n": small(n), "pos": small(pos), "pivot": whole(pivot), "fits": pa.array(fits[s]), "k": small(k), "parted": pa.array(parted[s])})

    def find(batches):
        now, loads = None, []
        for b in batches:
            for r, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != now and loads:
                    yield from shared(loads)
                    loads = []
                now = r
                loads.append(raw)
        if loads:
            yield from shared(loads)

    return entries.sortWithinPartitions("range").mapInArrow(frugal(find), _GROUPS)


def _long_enough(a, b, percent: int):
    """The length filter on two sizes."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _room(percent: int):
    """The positional filter: what can still be shared from the two places on suffices."""
    need = F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent))
    return F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= need - F.least("pos", "at")


def _bodies(classes: DataFrame, texts: DataFrame, cut: Sets) -> DataFrame:
    """(cls, body): a packed text of each of the classes, and of a few more."""
    classes = stored(classes.select(F.col("cls").alias("c")).distinct())
    wanted = bitmap_of(classes, "c", bits_for(2 * classes.count()))
    discard(classes)

    def bodies(batches):
        seen: set = set()
        for b in batches:
            buf, offs = text_buffer(b.column(0))
            for lo, _, _, _, names in cut.of(b, 0):
                rows = [r for r in np.flatnonzero(in_bitmap(wanted, names)).tolist() if names[r]]
                rows = [r for r, c in ((r, int(names[r])) for r in rows) if c not in seen and not seen.add(c)]
                if rows:
                    raw = [_pack(buf[offs[lo + r] : offs[lo + r + 1]].tobytes()) for r in rows]
                    yield pa.RecordBatch.from_pydict({"cls": pa.array(names[rows].view(np.int64)), "body": pa.array(raw, pa.binary())})

    # Classes reach here once a task; one of each is enough.
    return stored(texts.mapInArrow(frugal(bodies), "cls bigint, body binary").dropDuplicates(["cls"]))


def _sets_in(bodies: list[bytes], size: int) -> list[np.ndarray]:
    """The n-gram sets of packed texts."""
    out: list[np.ndarray] = []
    raw = [_unpack(x) for x in bodies]
    offs = np.cumsum([0, *map(len, raw)])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    for lo, hi in chunks(offs):
        sets, begin = shingle_sets(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size)
        out += [sets[a:b] for a, b in zip(begin[:-1], begin[1:])]
    return out


def _verified(pairs: DataFrame, texts: DataFrame, cut: Sets, percent: int) -> DataFrame:
    """Those of the pairs (cls, pivot, k) of classes whose sets link: (a, b), a table.

    A pivot's text is sent once for some dozens of members, by the size k of the group they met in.
    """
    part = F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.ceil(F.col("k") / STAR)))
    members = pairs.select("pivot", part.alias("part"), F.lit(True).alias("member"), "cls")
    pivots = members.select("pivot", "part", F.lit(False).alias("member"), F.col("pivot").alias("cls")).distinct()
    every = members.unionByName(pivots)
    held = _bodies(every, texts, cut)

    def check(batches):
        now = None
        for b in batches:
            pivot, part, member, cls = (b.column(i).to_pylist() for i in range(4))
            out = []
            for row, s in zip(zip(pivot, part, member, cls), _sets_in(b.column(4).to_pylist(), cut.size)):
                if not row[2]:
                    now = s.copy()
                elif links(now, s, percent):
                    out.append((row[3], row[0]))
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    stars = every.join(held, "cls").select("pivot", "part", "member", "cls", "body")
    stars = stars.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    found = stored(stars.mapInArrow(frugal(check), "a bigint, b bigint"))
    discard(held)
    return found


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (cls, pivot, k) that pass the suffix filter, before any text is sent."""

    @F.arrow_udf("boolean")
    def close(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array(may_link(x.to_pylist(), y.to_pylist(), n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False), percent), pa.bool_())

    c = lambda k: classes.select(F.col("cls").alias(k), F.col("fold").alias("f" + k), F.col("n").alias("n" + k))
    return pairs.join(c("cls"), "cls").join(c("pivot"), "pivot").where(close("fcls", "fpivot", "ncls", "npivot")).select("cls", "pivot", "k")


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) for all classes in links (a, b): comp is the smallest class of the component.

    Each round points every root at the smallest root next to it and then follows pointers to
    their ends; tables are cut by a written copy each round, and nothing reaches the driver but
    counts.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    names = stored(edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct().select("cls", F.col("cls").alias("comp")))
    while True:
        left = edges.join(names.select(F.col("cls").alias("a"), F.col("comp").alias("x")), "a").join(names.select(F.col("cls").alias("b"), F.col("comp").alias("y")), "b")
        across = stored(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(edges)
        if across.isEmpty():
            discard(across)
            return names
        # Every root hooks on to its smallest neighbour, which is smaller than itself.
        hook = stored(across.groupBy("b").agg(F.min("a").alias("up")).select(F.col("b").alias("root"), "up", F.lit(True).alias("moved")))
        while True:
            upper = hook.select(F.col("root").alias("up"), F.col("up").alias("top"))
            jumped = stored(hook.join(upper, "up", "left").select("root", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            discard(hook)
            hook = jumped
            if not hook.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
                break
        renamed = stored(names.join(hook.select(F.col("root").alias("comp"), "up"), "comp", "left").select("cls", F.coalesce("up", "comp").alias("comp")))
        discard(names, hook)
        names, edges = renamed, across


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """rows with comp, the class itself where it is in no link yet."""
    return rows.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))


def _unpaired(groups: DataFrame) -> DataFrame:
    """Members (gram, cls, n, pos) of groups that may hold pairs which haven't met yet: all but the
    pivot, where there are three members or more; all members of groups that met in parts."""
    return groups.where("parted OR (k > 2 AND cls <> pivot)").select("gram", "cls", "n", "pos")


def _several(members: DataFrame) -> DataFrame:
    """Per n-gram with members (with comp) of several components: a pivot from the largest one."""
    mine = F.struct(F.xxhash64("gram", "cls").alias("h"), "cls", "n", "pos", "comp")
    by_comp = members.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("k"), F.max(mine).alias("p"))
    best = by_comp.groupBy("gram").agg(F.max(F.struct("k", "p")).alias("m"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    p = F.col("m.p")
    return stored(best.select("gram", F.col("k").cast("int").alias("k"), F.col("m.k").cast("int").alias("largest"), p["cls"].alias("pivot"), p["n"].alias("m"), p["pos"].alias("at"), p["comp"].alias("other")))


def _other_pairs(members: DataFrame, percent: int, least: int) -> DataFrame:
    """Members of other components than the pivot's of their group with that pivot: (cls, pivot, k).

    Each group takes its own pivot: a class meets about as many different ones as it has n-grams.
    Groups of fewer than `least` members are left to the blocks.
    """
    met = members.join(_several(members).where(F.col("k") >= least), "gram")
    met = met.where((F.col("comp") != F.col("other")) & _long_enough(F.col("n"), F.col("m"), percent) & _room(percent))
    return met.groupBy("cls", "pivot").agg(F.max("k").alias("k"))


def _rest_edges(groups: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """Members of one group in different components that may link, each with one other member of
    what hangs together by such pairs.

    All pairs of a group pass the filters block by block, but only one row a member comes out.
    """
    g = groups.join(_several(groups).select("gram", "k", "largest", "other"), "gram")
    # Members of the group's largest component needn't meet each other: they have blocks of their
    # own, after the others' blocks, and go to the cells with those only. Small groups are one cell.
    single, inner = F.col("k") <= block, F.col("comp") == F.col("other")
    outer = F.when(single, 1).otherwise(F.ceil((F.col("k") - F.col("largest")) / block)).cast("int")
    g = g.withColumn("outer", outer).withColumn("blocks", F.col("outer") + F.when(single, 0).otherwise(F.ceil(F.col("largest") / block)).cast("int"))
    place = F.xxhash64("cls", F.lit("block"))
    own_blocks = F.greatest(F.col("blocks") - F.col("outer"), F.lit(1))
    mine = F.when(inner & ~single, F.col("outer") + F.pmod(place, own_blocks)).otherwise(F.pmod(place, F.col("outer")))
    g = g.withColumn("mine", mine.cast("int")).withColumn("met", F.when(inner, F.col("outer")).otherwise(F.col("blocks")))
    # A member goes to its block's row and column of the group's grid of block pairs.
    cell = F.transform(F.sequence(F.lit(0), F.col("met") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    g = g.select("gram", "cls", "n", "pos", "comp", "mine", "blocks", F.explode(cell).alias("cell"))

    def fits(t: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length and positional filters on rows x and y of t; different components only."""
        n, m, p, q = t[x, 4], t[y, 4], t[x, 5], t[y, 5]
        need = -(-(n + m) * percent // (100 + percent))
        ok = (t[x, 6] != t[y, 6]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
        return ok & (np.minimum(n - p, m - q) >= need - np.minimum(p, q))

    def row_pairs(t: np.ndarray, edges: np.ndarray, done: int):
        """Numbers of rows that meet: all at once for cells of one size, by member for large ones."""
        begin, size = edges[:done], np.diff(edges[: done + 1])
        small = (size <= 32) & (t[begin, 8] == 1)
        for k in np.unique(size[small & (size > 1)]).tolist():
            first = begin[small & (size == k)]
            i, j = np.triu_indices(k, 1)
            for lo in range(0, len(first), max(1, 400_000 // len(i))):
                f = first[lo : lo + max(1, 400_000 // len(i)), None]
                x, y = (f + i).ravel(), (f + j).ravel()
                ok = fits(t, x, y)
                yield x[ok], y[ok]
        for lo, k in zip(begin[~small], size[~small]):
            rows = np.arange(lo, lo + k)
            left, right = rows[t[rows, 7] == t[lo, 1]], rows[t[rows, 7] == t[lo, 2]]
            for x in left:
                y = right[right > x] if t[lo, 1] == t[lo, 2] else right
                y = y[fits(t, np.full(len(y), x), y)]
                if len(y):
                    yield np.full(len(y), x), y

    def meet(batches):
        """Batches are sorted by cell; the last cell of a batch waits for the next one."""
        held, folds, waiting = None, [], 0
        parts: list[np.ndarray] = []
        for last, b in with_last(batches):
            part = np.column_stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(9)])
            parts.append(part)
            folds += b.column(9).to_pylist()
            waiting += len(part)
            if waiting < 20_000 and not last:
                continue
            t = np.vstack(parts)
            edges = np.flatnonzero(np.r_[True, (t[1:, :3] != t[:-1, :3]).any(1), True]) if len(t) else np.zeros(1, np.int64)
            done = len(edges) - 1 if last else len(edges) - 2
            if done > 0:
                yield from passed(t, folds, row_pairs(t, edges, done))
            cut = edges[done] if not last and done >= 0 else len(t)
            parts, folds, waiting = [t[cut:]], folds[cut:], len(t) - cut

    def passed(t, folds, pairs):
        seen: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        xs, ys, count = [], [], 0

        def checked():
            x, y = np.concatenate(xs), np.concatenate(ys)
            # One row pair for each pair of classes.
            c = np.column_stack([np.minimum(t[x, 3], t[y, 3]), np.maximum(t[x, 3], t[y, 3])])
            _, at = np.unique(c, axis=0, return_index=True)
            x, y, c = x[at], y[at], c[at]
            return c[may_link([folds[i] for i in x], [folds[i] for i in y], t[x, 4], t[y, 4], percent)]

        for x, y in pairs:
            xs.append(x)
            ys.append(y)
            count += len(x)
            if count > 400_000:
                seen.append(checked())
                xs, ys, count = [], [], 0
        if count:
            seen.append(checked())
        got = np.vstack(seen)
        if len(got):
            # Each member with the smallest one of those it hangs together with here.
            names, at = np.unique(got, return_inverse=True)
            x, y = at.reshape(-1, 2).T
            low = np.arange(len(names))
            while True:
                m, new = np.minimum(low[x], low[y]), low.copy()
                np.minimum.at(new, x, m)
                np.minimum.at(new, y, m)
                new = new[new]
                if (new == low).all():
                    break
                low = new
            rest = np.flatnonzero(low != np.arange(len(names)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(names[rest]), "b": pa.array(names[low[rest]])})

    cells = g.join(classes.select("cls", "fold"), "cls")
    cells = cells.select("gram", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "cls", "n", "pos", "comp", "mine", "blocks", "fold")
    cells = cells.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
    return cells.mapInArrow(frugal(meet), "a bigint, b bigint").distinct()


def _family_links(families: DataFrame, comps: DataFrame, texts: DataFrame, cut: Sets, percent: int, block: int) -> DataFrame:
    """Links (a, b) that join components inside families (cls, comp as the family's name); a table.

    Whole texts meet in the cells of a family's grid of blocks, so that each pair is looked at
    once; a cell gives no more links than it needs to join what it joins.
    """
    members = _with_components(families.withColumnRenamed("comp", "family"), comps)
    sizes = stored(members.groupBy("family").agg(F.count(F.lit(1)).alias("k")))
    members = members.join(sizes, "family").withColumn("blocks", F.ceil(F.col("k") / block).cast("int"))
    members = members.withColumn("mine", F.pmod(F.xxhash64("cls", F.lit("family")), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("mine", o).alias("i"), F.greatest("mine", o).alias("j")))
    members = members.select("family", "cls", "comp", "mine", F.explode(cell).alias("cell"))
    held = _bodies(families.select("cls"), texts, cut)
    cells = members.join(held, "cls").select("family", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "cls", "comp", "mine", "body")
    cells = cells.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")

    def joined(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        sets = _sets_in([r[6] for r in rows], cut.size)
        n = np.array([len(s) for s in sets])
        folds = [fold(s) for s in sets]
        up = {r[4]: r[4] for r in rows}

        def top(c):
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        mine, out = np.array([r[5] for r in rows]), []
        right = np.flatnonzero(mine == j)
        for x in np.flatnonzero(mine == i).tolist():
            y = right[right > x] if i == j else right
            here = top(rows[x][4])
            y = np.array([k for k in y.tolist() if top(rows[k][4]) != here], np.int64)
            if not len(y):
                continue
            y = y[may_link([folds[x]] * len(y), [folds[k] for k in y.tolist()], np.full(len(y), n[x]), n[y], percent)]
            for k in y.tolist():
                a, b = top(rows[x][4]), top(rows[k][4])
                if a != b and links(sets[x], sets[k], percent):
                    up[a] = b
                    out.append((rows[x][3], rows[k][3]))
        return out

    def meet(batches):
        rows: list[tuple] = []
        for last, b in with_last(batches):
            rows += zip(*(b.column(k).to_pylist() for k in range(7)))
            edges = [k for k in range(len(rows)) if not k or rows[k][:3] != rows[k - 1][:3]] + [len(rows)]
            done = len(edges) - 1 if last else len(edges) - 2
            got = [p for lo, hi in zip(edges[:done], edges[1 : done + 1]) if hi - lo > 1 for p in joined(rows[lo:hi])]
            rows = rows[edges[max(done, 0)] :] if rows else rows
            if got:
                yield pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in got], pa.int64()), "b": pa.array([p[1] for p in got], pa.int64())})

    found = stored(cells.mapInArrow(frugal(meet), "a bigint, b bigint"))
    discard(held, sizes)
    return found


def _named(cut: Sets):
    @F.arrow_udf("bigint")
    def named(text: pa.Array) -> pa.Array:
        got = [names.view(np.int64) for *_, names in cut.of(pa.RecordBatch.from_arrays([text], names=["t"]), 0)]
        return pa.array(np.concatenate([np.empty(0, np.int64), *got]))

    return named


def _linked_classes(scan: DataFrame, texts: DataFrame, cut: Sets, percent: int, sketch_bits: int, split: int, pivot_turns: int, block: int) -> DataFrame:
    """(cls, comp) of the classes that link with another; comp names the component."""
    spark = texts.sparkSession
    level, total = _levels(scan, sketch_bits)
    classes = stored(scan.where("fold IS NOT NULL").select("cls", "n", "fold").dropDuplicates(["cls"]))
    prefixes = total * (100 - percent) // 100
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prefixes // PER_TASK))
    entries = _entries(texts, cut, percent, Entries(level, tasks, split))
    groups = stored(_shared_grams(entries.repartitionById(tasks, F.pmod("range", F.lit(tasks)).cast("int")), percent))
    del level
    members = _unpaired(groups)
    found: list[DataFrame] = []
    comps = spark.createDataFrame([], "cls bigint, comp bigint")
    for turn in range(pivot_turns):
        if turn == 0:
            pairs = groups.where("fits").groupBy("cls", "pivot").agg(F.max("k").alias("k"))
        else:
            pairs = _other_pairs(_with_components(members, comps), percent, 2 * block)
        pairs = stored(_plausible(pairs, classes, percent))
        if pairs.isEmpty():
            discard(pairs)
            break
        found.append(_verified(pairs, texts, cut, percent))
        discard(pairs)
        comps = components(reduce(DataFrame.union, found))
    if not pivot_turns:  # nothing has met its pivot
        members = groups.select("gram", "cls", "n", "pos")
    edges = stored(_rest_edges(_with_components(members, comps), classes, percent, block))
    discard(groups, classes)
    if edges.isEmpty():
        return comps
    found.append(_family_links(components(edges), comps, texts, cut, percent, block))
    return components(reduce(DataFrame.union, found))


def _near(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str, sketch_bits: int, split: int, pivot_turns: int, block: int, name_bits: int) -> tuple[DataFrame, Sets]:
    short_batches(docs.sparkSession)
    cut = Sets(size, name_bits)
    scan = _scanned(docs, id_column, text_column, cut, sketch_bits)
    if twins := _twins(scan):
        cut = Sets(size, name_bits, twins)
        scan = scan.withColumn("cls", F.when(F.col("cls").isin(*twins), F.col("other")).otherwise(F.col("cls")))
    rows = scan.where("fold IS NULL AND slice IS NULL").select(F.col("id").alias("doc_id"), "n", "cls")
    comps = _linked_classes(scan, docs.select(F.col(text_column).alias("text")), cut, percent, sketch_bits, split, pivot_turns, block)
    names = rows.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    names = stored(names.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    # Tables of their own, so that adaptive execution can split the joins' hot keys.
    low = stored(names.groupBy("comp").agg(F.min("low").alias("component_id")))
    names = stored(names.join(low, "comp").select("cls", "comp", "component_id"))
    out = rows.join(names, "cls", "left")
    alone = (F.col("cls") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("cls").alias("class_id"), F.col("comp").alias("component")), cut


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 75,
    id_column: str = "doc_id",
    text_column: str = "text",
    sketch_bits: int = 24,
    split: int = 100_000,
    pivot_turns: int = 2,
    block: int = 128,
    name_bits: int = 64,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id, component (a class).

    split: members of a common n-gram's group that meet in one place; name_bits: of class names.
    """
    return _near(docs, size, percent, id_column, text_column, sketch_bits, split, pivot_turns, block, name_bits)[0]


def keep_one(
    docs: DataFrame,
    size: int = 5,
    percent: int = 75,
    id_column: str = "doc_id",
    text_column: str = "text",
    sketch_bits: int = 24,
    split: int = 100_000,
    pivot_turns: int = 2,
    block: int = 128,
    name_bits: int = 64,
) -> DataFrame:
    """The rows of docs that stay: of each component the one with the smallest doc_id.

    Rows of classes that nothing else has a link to pass straight through, and so does a
    component's smallest one if it is alone in its class. Rows without a doc_id stay; of repeated
    rows with the smallest doc_id one stays.
    """
    found, cut = _near(docs, size, percent, id_column, text_column, sketch_bits, split, pivot_turns, block, name_bits)
    found = found.where("class_id <> 0 AND doc_id IS NOT NULL")
    by_class = found.groupBy("class_id").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("low"), F.first("component_id").alias("keep"))
    cls, keep, maybe = fresh(docs, "cls", "keep", "may")
    classes = stored(by_class.where("rows > 1 OR low <> keep").select("class_id", "keep").toDF(cls, keep))
    known = bitmap_of(classes, cls, bits_for(classes.count()))
    marked = docs.withColumn(cls, _named(cut)(F.col(text_column))).withColumn(maybe, maybe_in(known)(F.col(cls)) & F.col(id_column).isNotNull())
    alone = marked.where(~F.col(maybe))
    met = marked.where(F.col(maybe)).join(classes, cls, "left")
    stay = met.where(F.col(id_column) == F.col(keep)).dropDuplicates([keep])
    names = [own(x) for x in docs.columns]
    return alone.select(*names).unionAll(met.where(F.col(keep).isNull()).select(*names)).unionAll(stay.select(*names))


#: The same components over documents for DuckDB, by all pairs that share an n-gram.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' '))
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY ALL
"""
