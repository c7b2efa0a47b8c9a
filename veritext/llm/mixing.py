"""Mixing sources to target weights by weighted fair queueing. Native: DataFrame functions only.

Within its source, each document stands at a place given by a hash of its doc_id (ties:
doc_id, size). Copy e of a document finishes at virtual time

    (e * words of the source + words of the source up to and with the document) / weight

for e = 0, 1, 2 (`most_repeats` copies at most). All copies are sorted by that time and taken
until the budget is full. That is the fair share: sources advance in step, one that has run
out stops, and what it leaves goes to the others by weight, so that each target is
min(weight * T, most_repeats * size) for the one time T at which targets sum to the budget.

Scale: running sums never gather a source in one task. Rows fall into buckets of the hash
range (per source) and of virtual time (globally); sums run inside buckets, bucket totals are
summed inside runs of `RUN` buckets, and the runs' totals, a row for some millions of documents,
on their own. The number of buckets follows the number of rows. T comes from one row per source.
Rows that share a doc_id and a text stand at one place, as one entry with a count, so that a row
repeated a million times is no full bucket.

Null or empty texts have size 0 and are taken with 0 words; of long ones all words count. A null source is a source of its
own, ordered last. Ties of the hash go by doc_id and size. Rows repeated with the same doc_id are mixed one by one. An empty table
gives an empty result; if all sizes are 0, every target is 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritext.llm._shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Slots whose sums are added up in one task, and alike rows that are written out at once.
RUN = 1_024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """sources(source, source_size) -> with weight, target, cutoff time as num / den.

    One row per source; the windows without a key run over that many rows.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    cases = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.select("source", "source_size", cases.cast("long").alias("weight"))
    # Sources that reach their cap first come first.
    by_cap = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most_repeats).over(before), F.lit(0))).alias("num"),
        F.sum("weight").over(after).alias("den"),
        F.sum("source_size").over(everything).alias("budget"),
    )
    fits = F.col("num") * F.col("weight") <= F.col("source_size") * most_repeats * F.col("den")
    at = F.min(F.when(fits, F.struct((F.col("source_size") / F.col("weight")).alias("c"), F.col("num").alias("num"), F.col("den").alias("den")))).over(everything)
    s = s.select("source", "source_size", "weight", "budget", at["num"].alias("t_num"), at["den"].alias("t_den"))
    capped = F.col("t_num") * F.col("weight") > F.col("source_size") * most_repeats * F.col("t_den")
    share = (F.col("t_num") * F.col("weight")).cast("double") / F.col("t_den").cast("double")
    return s.withColumn("target", F.when(capped, (F.col("source_size") * most_repeats).cast("double")).otherwise(share))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    most_repeats: int = 3,
    seed: int = 17,
    rows_per_bucket: int = 20_000,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken."""
    # The order inside a source is that of a 60-bit code; SQL engines agree on md5.
    code = F.conv(F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"), code.alias("code")
    )
    # Rows alike are one entry; the texts are read once.
    entries = stored(rows.groupBy("source", "code", "doc_id", "size").agg(F.count(F.lit(1)).alias("times")))
    buckets = max(64, -(-entries.count() // rows_per_bucket))
    entries = entries.withColumn("bucket", F.expr(f"code div {-(-(1 << 60) // buckets)}"))
    words = F.col("size") * F.col("times")
    steps = entries.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_size"))
    totals = source_targets(steps.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most_repeats)
    totals = totals.select(F.col("source").alias("s"), "source_size", "weight", "t_num", "t_den", "target", "budget")
    # 1. Running sums inside (source, bucket), on top of the sums of earlier buckets.
    inside = Window.partitionBy("source", "bucket").orderBy("code", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = entries.withColumn("here", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("base"))
    steps = steps.join(totals, steps["s"].eqNullSafe(totals["s"])).drop(totals["s"])
    placed = placed.join(steps, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b", "bucket")
    # Alike rows with words finish one after the other; those without all at once, and stay one entry.
    placed = _numbered(placed, F.when(F.col("size") > 0, F.col("times")).otherwise(1)).withColumn("times", F.when(F.col("size") > 0, 1).otherwise(F.col("times")))
    # 2. Virtual finish times of the copies, and a global range sort by slots of virtual time.
    finish = (F.col("e") * F.col("source_size") + F.col("base") + F.col("here") + F.col("nth") * F.col("size")) / F.col("weight")
    copies = placed.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(most_repeats - 1)))).withColumn("finish", finish)
    cutoff = F.when(F.col("t_num") > 0, F.col("t_num") / F.col("t_den")).otherwise(F.lit(1.0))
    copies = copies.withColumn("slot", F.floor(F.col("finish") / cutoff * buckets).cast("long"))
    order = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "code", "doc_id", "e", "nth")
    copies = copies.withColumn("within", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    slots = copies.groupBy("slot").agg(F.sum("size").alias("slot_size")).withColumn("run", F.expr(f"slot div {RUN}"))
    before = Window.partitionBy("run").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select(F.col("slot").alias("p"), "run", F.coalesce(F.sum("slot_size").over(before), F.lit(0)).alias("ahead_in_run"), "slot_size")
    # A row per RUN slots.
    runs = slots.groupBy("run").agg(F.sum("slot_size").alias("run_size"))
    runs = runs.select("run", F.coalesce(F.sum("run_size").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead_of_run"))
    slots = slots.join(runs, "run").select("p", (F.col("ahead_of_run") + F.col("ahead_in_run")).alias("ahead"))
    copies = copies.join(slots, F.col("slot") == F.col("p"))
    # 3. Truncation at the budget.
    admitted = F.col("ahead") + F.col("within") <= F.col("budget")
    each = copies.groupBy("source", "code", "doc_id", "size", "nth").agg(
        F.first("times").alias("times"),
        F.first("source_size").alias("source_size"),
        F.first("target").alias("target"),
        F.sum(F.when(admitted, 1).otherwise(0)).cast("long").alias("copies"),
    )
    return _numbered(each.drop("nth"), F.col("times")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _numbered(rows: DataFrame, times: Column) -> DataFrame:
    """Each row as often as it says, numbered from 1 (nth); in two steps, so that no array is long."""
    runs = rows.withColumn("__times", times.cast("long")).withColumn("__run", F.explode(F.expr(f"sequence(0L, (__times - 1) div {RUN})")))
    return runs.withColumn("nth", F.explode(F.expr(f"sequence(__run * {RUN} + 1, least(__times, (__run + 1) * {RUN}))"))).drop("__times", "__run")


#: The same mix for DuckDB; {docs} is the table, weights (5, 2, 1), three copies at most.
MIX_SQL = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS code FROM {docs}),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s0),
s2 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS budget,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS num,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS den
       FROM s1 WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
t AS (SELECT num, den FROM s2 WHERE num * weight <= source_size * 3 * den ORDER BY source_size / weight, source NULLS LAST LIMIT 1),
s3 AS (SELECT s2.source, source_size, weight, budget, t.num AS n, t.den AS d,
         CASE WHEN t.num * weight > source_size * 3 * t.den THEN (source_size * 3)::DOUBLE ELSE (t.num * weight)::DOUBLE / t.den::DOUBLE END AS target FROM s2, t),
p AS (SELECT r.*, s3.source_size, s3.weight, s3.target, s3.budget,
         sum(size) OVER (PARTITION BY r.source ORDER BY code, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS here
       FROM r JOIN s3 ON r.source IS NOT DISTINCT FROM s3.source),
c AS (SELECT p.*, e, (e * source_size + here) / weight AS finish FROM p, range(3) AS g(e)),
a AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, code, doc_id, e ROWS UNBOUNDED PRECEDING) AS cum FROM c)
SELECT doc_id, source, size, source_size, target, sum((cum <= budget)::INT)::BIGINT AS copies, (sum((cum <= budget)::INT) * size)::BIGINT AS taken
FROM a GROUP BY doc_id, source, size, source_size, target, here
"""
