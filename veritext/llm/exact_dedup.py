"""Exact duplicates: local winners, salted groups, global winners; the whole content is compared.

Texts are equal when they are identical after each run of white space (0x20, 0x09-0x0D) has
become one space. A digest only routes rows: at each stage the normalised text itself is part
of the grouping key, so that two texts with one digest would stay apart.

1. Each task combines the equal texts it has read (Spark's map-side aggregation).
2. What is left is merged by (salt, digest, text). A text that a third of all rows hold
   arrives as one row a task, dealt over `salts` reducers.
3. The salt winners are merged by (digest, text).
4. Rows find their group's winner by (digest, salt, text) again, the winners of groups of `big` rows
   or more being there once a salt, so that no task gets a whole large group. Which rows can have
   a copy at all, and which groups are large, is told by bitmaps of bounded size (32 MB at most): the
   other rows stand alone and aren't shuffled; a false hit only costs a row's way.

Null texts count as empty and are duplicates of each other; long texts are handled as a whole.
Ties: a null doc_id loses against any other; of repeated rows with the smallest doc_id one stays.
They are alike in all that comes out, so they are counted and told apart by number, not by their
place in the input, which another run may read in another order. Other columns are not looked at.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritext.llm._shared import bitmap_of, bits_for, fresh, maybe_in, own, stored

SPACE = r"[\x20\x09-\x0D]+"
#: Rows that a repeated row is written out in at once.
RUN = 1_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def duplicate_texts(docs: DataFrame, salts: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(sha, norm, keep_id, group_size) of the texts that two or more rows hold."""
    rows = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("norm"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    salted = rows.groupBy(salt.alias("salt"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("sha", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).where("group_size > 1")


class Winners:
    """The groups of two or more rows, as a table, and the bitmaps of their codes."""

    def __init__(self, docs: DataFrame, salts: int, big: int, id_column: str, text_column: str):
        self.salts = salts
        groups = duplicate_texts(docs, salts, id_column, text_column).withColumn("code", F.xxhash64("norm"))
        self.groups = stored(groups)
        sizes = self.groups.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("group_size") >= big).alias("big")).first()
        self.may_have_copies = self._codes(self.groups, sizes["all"])
        self.may_be_big = self._codes(self.groups.where(F.col("group_size") >= big), sizes["big"])

    @staticmethod
    def _codes(groups: DataFrame, count: int):
        if not count:
            return lambda code: F.lit(False)
        return maybe_in(bitmap_of(groups, "code", bits_for(count, least=16)))

    def row_salt(self, code: Column, spread: Column) -> Column:
        return F.when(self.may_be_big(code), F.pmod(spread, F.lit(self.salts))).otherwise(0).cast("int")

    def salted(self) -> DataFrame:
        """A winner for each salt that rows of its code may have."""
        many = F.sequence(F.lit(0), F.lit(self.salts - 1))
        one = F.array(F.lit(0))
        marked = self.groups.withColumn("large", self.may_be_big(F.col("code")))
        return marked.select("sha", "norm", "keep_id", "group_size", F.explode(F.when(F.col("large"), many).otherwise(one)).alias("salt"))


def exact_groups(docs: DataFrame, salts: int = 16, big: int = 1_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    winners = Winners(docs, salts, big, id_column, text_column)
    rows = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("norm"))
    rows = rows.withColumn("code", F.xxhash64("norm"))
    one = F.lit(1).cast("long")
    alone = rows.where(~winners.may_have_copies(F.col("code"))).select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))
    marked = rows.where(winners.may_have_copies(F.col("code"))).withColumn("salt", winners.row_salt(F.col("code"), F.xxhash64("doc_id", F.lit("row"))))
    met = marked.withColumn("sha", F.unhex(F.sha2("norm", 256))).join(winners.salted(), ["sha", "salt", "norm"], "left")
    found = F.col("group_size").isNotNull()
    met = met.select(
        "doc_id",
        F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", one).alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    # Alike rows are counted; of those with the smallest doc_id the first one is kept.
    alike = met.groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("times"))
    runs = alike.withColumn("run", F.explode(F.expr(f"sequence(0L, (times - 1) div {RUN})")))
    each = runs.withColumn("nth", F.explode(F.expr(f"sequence(run * {RUN}, least(times, (run + 1) * {RUN}) - 1)")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)
    return alone.unionByName(each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, salts: int = 16, big: int = 1_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows that can't have a copy pass straight through; only the others, copies and a few false
    hits, are joined with the winners.
    """
    winners = Winners(docs, salts, big, id_column, text_column)
    sha, norm, code, salt, keep, n = fresh(docs, "sha", "norm", "code", "salt", "keep", "n")
    marked = docs.withColumn(norm, normalised(F.col(text_column))).withColumn(code, F.xxhash64(norm))
    names = [own(x) for x in docs.columns]
    alone = marked.where(~winners.may_have_copies(F.col(code))).select(*names)
    marked = marked.where(winners.may_have_copies(F.col(code))).withColumn(salt, winners.row_salt(F.col(code), F.xxhash64(F.col(id_column), F.lit("row"))))
    known = winners.salted().select(F.col("sha").alias(sha), F.col("salt").alias(salt), F.col("norm").alias(norm), F.col("keep_id").alias(keep), F.col("group_size").alias(n))
    met = marked.withColumn(sha, F.unhex(F.sha2(norm, 256))).join(known, [sha, salt, norm], "left")
    false_hits = met.where(F.col(n).isNull())
    # Of repeated rows with the winning doc_id any one may stay: they agree in id and text.
    stay = met.where(F.col(n).isNotNull() & F.col(id_column).eqNullSafe(F.col(keep))).dropDuplicates([sha, norm])
    return alone.unionAll(false_hits.select(*names)).unionAll(stay.select(*names))
