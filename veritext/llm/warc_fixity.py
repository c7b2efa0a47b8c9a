r"""WARC records and a Merkle fixity audit of replicas.

Records of a replica get their place from their number: file = id div `per_file`, slot = the rest.
A leaf is a slot: number of records, bytes, and a digest of the records' sha256 (the record's
own for one record; else an order-free sum, so that repeated records need no list). Offsets are
running sums over a file's slots. `fanout` neighbours make a node, whose digest covers their
places, byte ranges and digests in order; files are the leaves of the tree above them.

The audit compares the roots of two replicas; if they agree it is done. Where they differ it goes
down level by level, comparing only children of differing nodes, until differing slots remain:
changed, missing (not in the replica) or extra (not in the original).

Scale: a record is read once a replica, and is reduced to one short row in the scan; nodes
hold `fanout` children, windows hold one file. Leaves and the files' roots are tables in the shared
scratch folder; the trees inside files are built again for files that differ only. All steps are
DataFrame functions.

Null fields are empty; a null number is slot 0 of file -1, where negative numbers may lie, too. Long
records are hashed as a whole. Ties and repeated rows: several records with one number share a slot and
are audited together. Empty replicas have no root: against a table with records, all are
missing or extra. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritext.llm._shared import discard, stored

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"


def record(url: Column, body: Column, more: Column | None = None) -> Column:
    """The text of a WARC response record; more: further header lines."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat(F.lit(VERSION + "WARC-Type: response\r\n"), F.lit("") if more is None else more, F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit("")))
    return F.concat(head, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body, F.lit(END))


def write_warc(pages: DataFrame, path: str, url_column: str = "url", body_column: str = "html", compression: str = "none", per_file: int = 4096) -> None:
    """Write pages as WARC files of at most `per_file` records; compression: none or gzip.

    A record's id is made of its address and body, so that another run writes the same one.
    """
    name = F.md5(F.concat_ws("\n", F.coalesce(F.col(url_column), F.lit("")), F.coalesce(F.col(body_column), F.lit(""))))
    parts = F.concat_ws("-", *[F.substring(name, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    more = F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), parts, F.lit(">\r\nWARC-Date: "), date, F.lit("\r\n"))
    text = record(F.col(url_column), F.col(body_column), more)
    # The line separator is a record's end mark.
    rows = pages.select(F.substring(text, F.lit(1), F.length(text) - len(END)).alias("value"))
    rows.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """url, html, intact of all records of WARC files, gzipped ones too.

    Records are framed by their Content-Length, whatever stands in a body; one that doesn't end
    where it says isn't intact, and reading goes on at the next record's first line. A file is read as a whole.
    """

    def parsed(batches):
        for b in batches:
            for raw in b.column(0).to_pylist():
                rows = list(_records(_inflated(raw)))
                yield pa.RecordBatch.from_pydict({"url": pa.array([r[0] for r in rows], pa.string()), "html": pa.array([r[1] for r in rows], pa.string()), "intact": pa.array([r[2] for r in rows], pa.bool_())})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, "url string, html string, intact boolean")


def _inflated(raw: bytes) -> bytes:
    out = []
    while raw[:2] == b"\x1f\x8b":  # one member after the other
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw) + d.flush())
        raw = d.unused_data
    return b"".join([*out, raw])


def _records(raw: bytes):
    end, at = END.encode(), 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        body = raw.find(end, at) + len(end)
        if body < len(end):
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw[at:body].decode("utf-8", "replace").split("\r\n")[1:])}
        size = int(n) if (n := fields.get("content-length", "")).isdecimal() else -1
        intact = size >= 0 and raw[body + size : body + size + len(end)] == end
        if not intact:
            nxt = raw.find(end + b"WARC/", body - len(end))
            size = (nxt if nxt >= 0 else len(raw) - len(end) * raw.endswith(end)) - body
        yield fields.get("warc-target-uri", ""), raw[body : body + max(size, 0)].decode("utf-8", "replace"), intact
        at = body + max(size, 0)


def _below(column: str, by: int) -> Column:
    """The whole part of a division, rounded down, on whole numbers of any size."""
    return F.expr(f"{column} div {by} - if({column} % {by} < 0, 1, 0)")


def leaves(records: DataFrame, per_file: int = 4096, id_column: str = "page_id", record_column: str = "record") -> DataFrame:
    """(file, slot, records, length, digest, offset) of a replica."""
    body = F.coalesce(F.col(record_column), F.lit(""))
    rows = records.select(F.col(id_column).cast("bigint").alias("id"), F.octet_length(body).cast("long").alias("length"), F.sha2(body, 256).alias("sha"))
    place = rows.select(
        F.coalesce(_below("id", per_file), F.lit(-1)).cast("long").alias("file"),
        F.coalesce(F.pmod("id", F.lit(per_file)), F.lit(0)).cast("int").alias("slot"),
        "length",
        "sha",
    )
    pieces = [F.sum(F.conv(F.substring("sha", i, 15), 16, 10).cast("decimal(38,0)")) for i in (1, 16, 31, 46)]
    grouped = place.groupBy("file", "slot").agg(
        F.count(F.lit(1)).alias("records"), F.sum("length").alias("length"), F.min("sha").alias("one"), F.concat_ws(":", *[p.cast("string") for p in pieces]).alias("many")
    )
    digest = F.when(F.col("records") == 1, F.col("one")).otherwise(F.sha2(F.concat_ws(":", F.col("records").cast("string"), "many"), 256))
    before = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.select("file", "slot", "records", "length", digest.alias("digest"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def _parents(level: DataFrame, fanout: int) -> DataFrame:
    """Nodes over a level (tree, node, length, digest): `fanout` neighbours each."""
    child = F.struct("node", "length", "digest")
    return (
        level.groupBy("tree", _below("node", fanout).cast("long").alias("up"))
        .agg(F.array_sort(F.collect_list(child)).alias("c"), F.sum("length").alias("length"))
        .select("tree", F.col("up").alias("node"), "length", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["length"].cast("string"), x["digest"])), "|"), 256).alias("digest"))
    )


def levels(leaf: DataFrame, width: int, fanout: int) -> list[DataFrame]:
    """Levels over nodes 0 to width - 1 of each tree, from the nodes up to the root."""
    out = [leaf]
    while width > 1:
        width = -(-width // fanout)
        out.append(_parents(out[-1], fanout))
    return out


def _slots(leaf: DataFrame) -> DataFrame:
    """Slots as the nodes of their file's tree."""
    return leaf.select(F.col("file").alias("tree"), F.col("slot").cast("long").alias("node"), "length", "digest")


def file_roots(leaf: DataFrame, per_file: int = 4096, fanout: int = 16) -> DataFrame:
    """The roots of the files' trees, as nodes of the tree of files; file -1 stands beside file 0."""
    roots = levels(_slots(leaf), per_file, fanout)[-1]
    return stored(roots.select(F.lit(None).cast("long").alias("tree"), (F.col("tree") + 1).alias("node"), "length", "digest"))


def _differing(a: DataFrame, b: DataFrame, within: DataFrame | None, fanout: int) -> DataFrame:
    """(tree, node, state) of nodes that differ, below differing nodes only."""
    if within is not None:
        keep = within.select(F.col("tree").alias("t"), F.col("node").alias("n"))
        a, b = (x.join(keep, x["tree"].eqNullSafe(F.col("t")) & (_below("node", fanout) == F.col("n")), "left_semi") for x in (a, b))
    x, y = a.select("tree", "node", F.col("digest").alias("da")), b.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("digest").alias("db"))
    met = x.join(y, x["tree"].eqNullSafe(y["t"]) & (x["node"] == y["n"]), "full")
    state = F.when(F.col("da").isNull(), "extra").when(F.col("db").isNull(), "missing").otherwise("changed")
    return met.where(~F.col("da").eqNullSafe(F.col("db"))).select(F.coalesce("tree", "t").alias("tree"), F.coalesce("node", "n").alias("node"), state.alias("state"))


def _descended(a: list[DataFrame], b: list[DataFrame], found: DataFrame | None, fanout: int) -> DataFrame | None:
    """The nodes of the lowest level that differ, going down from differing nodes; None if the roots agree."""
    for k in reversed(range(len(a))):
        below = stored(_differing(a[k], b[k], found, fanout))
        if found is not None:
            discard(found)
        elif below.isEmpty():
            return None
        found = below
    return found


def audit(original: DataFrame, replica: DataFrame, per_file: int = 4096, fanout: int = 16) -> DataFrame:
    """original, replica: leaves(). (file, slot, state) of the slots that differ.

    The tree of files tells the files that differ; only their slots are looked at again, and only
    their trees are built once more, to go down in.
    """
    last = original.select("file").union(replica.select("file")).agg(F.max("file")).first()[0]
    files = (last if last is not None else -1) + 2
    roots = [file_roots(x, per_file, fanout) for x in (original, replica)]
    found = _descended(*(levels(x, files, fanout) for x in roots), None, fanout)
    if found is None:
        discard(*roots)
        return original.sparkSession.createDataFrame([], "file bigint, slot int, state string")
    differ = stored(found.select((F.col("node") - 1).alias("file")))
    inner = [stored(_slots(x.join(differ, "file", "left_semi"))) for x in (original, replica)]
    found = _descended(*(levels(x, per_file, fanout) for x in inner), None, fanout)
    discard(differ, *roots, *inner)
    return found.select(F.col("tree").alias("file"), F.col("node").cast("int").alias("slot"), "state")


def fixity_report(original: DataFrame, replica: DataFrame, per_file: int = 4096, fanout: int = 16, id_column: str = "page_id", record_column: str = "record") -> DataFrame:
    """Per slot of either replica: file, slot, records, offset, length, digest (original's), state."""
    a, b = (stored(leaves(x, per_file, id_column, record_column)) for x in (original, replica))
    found = audit(a, b, per_file, fanout)
    states = found.select(F.col("file").alias("f"), F.col("slot").alias("s"), "state")
    met = a.join(states, (F.col("file") == F.col("f")) & (F.col("slot") == F.col("s")), "full")
    return met.select(
        F.coalesce("file", "f").alias("file"), F.coalesce("slot", "s").alias("slot"), "records", F.col("offset"), "length", "digest", F.coalesce("state", F.lit("same")).alias("state")
    )
