"""Plumbing that the corpus operators share: scratch tables, fixed-size bitmaps, Arrow chunks."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch of texts; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local one only in local mode (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="veritext-")
    path = f"{root.rstrip('/')}/veritext-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    for made in _made:
        made.append(path)
    return path


#: Folders made so far, for each stored_alone() that is running.
_made: list[list[str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already; the folder belongs to the scratch space
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: lineage is cut there."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """stored(make()), and all other tables made on the way deleted: nothing reads them any more."""
    _made.append([])
    kept = None
    try:
        table = stored(make())
        kept = table._scratch
        return table
    finally:
        for path in _made.pop():
            if path != kept:
                _remove(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored() that nothing will read any more."""
    for t in tables:
        _remove(t.sparkSession, t._scratch)


def short_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, as texts may be long; only ever lowers the session's setting."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]?)[a-z]*", spark.conf.get(key, f"{64 << 20}b").lower()).groups()
    now = int(number) << 10 * max("bkmgtp".find(unit), 0)
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def frugal(run: Callable) -> Callable:
    """A mapInArrow function whose task gives its memory back at the end: Python workers are kept
    for later tasks and would go on holding what the largest one needed."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; a row that is longer stands alone."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def bitmap_of(keys: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """A bitmap of 2**log2_bits bits with the bits of all keys (64-bit, well mixed) set.

    The size is fixed, whatever the number of keys. It serves to leave rows out early that
    cannot match; a bit set by another key only costs work, as an exact step always follows.
    """
    slices = 16
    per = (1 << log2_bits) // slices
    pos = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    places = keys.select(pos.alias("p"))

    def fold(batches):
        bits = np.zeros(slices * per // 8, np.uint8)
        some = False
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False)
            np.bitwise_or.at(bits, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
            some = some or len(p) > 0
        if some:
            yield from _slices(bits, slices)

    def join(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(_unpack(x), np.uint8)
                held[s] = x | held[s] if s in held else x
        for s, x in held.items():
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "bits": pa.array([_pack(x.tobytes())], pa.binary())})

    schema = "s int, bits binary"
    got = places.mapInArrow(frugal(fold), schema).repartition(slices, "s").mapInArrow(frugal(join), schema).collect()
    out = np.zeros(slices * per // 8, np.uint8)
    size = per // 8
    for r in got:
        out[r["s"] * size : (r["s"] + 1) * size] |= np.frombuffer(_unpack(bytes(r["bits"])), np.uint8)
    return out


def _slices(bits: np.ndarray, slices: int):
    size = len(bits) // slices
    for s in range(slices):
        part = bits[s * size : (s + 1) * size]
        if part.any():
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "bits": pa.array([_pack(part.tobytes())], pa.binary())})


def _pack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


def bits_for(keys: int, least: int = 20, most: int = 28) -> int:
    """log2 of a bitmap's size: 16 bits a key, between 128 KB and 32 MB whatever the input."""
    return min(most, max(least, (16 * max(keys, 1) - 1).bit_length()))


def with_last(items):
    """(is it the last one, item) of each."""
    it = iter(items)
    try:
        now = next(it)
    except StopIteration:
        return
    for nxt in it:
        yield False, now
        now = nxt
    yield True, now


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be in the bitmap."""
    p = keys.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1


def maybe_in(bits: np.ndarray):
    """A condition on a bigint column: its value may be in the bitmap."""

    @F.arrow_udf("boolean")
    def may(keys: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits, keys.to_numpy(zero_copy_only=False).view(np.uint64)), pa.bool_())

    return may


def own(name: str) -> Column:
    """A column by its plain name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
