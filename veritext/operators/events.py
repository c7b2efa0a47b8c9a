"""Event operators over tables: request sets, settling, limits, deadlines. C9, batch forms."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since 1970 with microseconds, as a double; for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def in_flight(events: DataFrame, by: list[str], kind: str = "kind", started: str = "started", ended: tuple[str, ...] = ("finished", "failed")) -> DataFrame:
    """Ids that have started and not ended; a set, so that a second start counts once."""
    open_ = events.where(F.col(kind) == started).select(*by).distinct()
    return open_.join(events.where(F.col(kind).isin(*ended)).select(*by).distinct(), by, "left_anti")


def latest(events: DataFrame, by: str, value: str, ts: str, tie: str) -> DataFrame:
    """The value of the last event of each key."""
    return events.groupBy(by).agg(F.max(F.struct(ts, tie, value)).alias("m")).select(by, F.col(f"m.{value}").alias(value), F.col(f"m.{ts}").alias(ts))


def first_wins(events: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """The first value of each key."""
    return events.groupBy(*by).agg(F.min(F.struct(*order, value)).alias("m")).select(*by, F.col(f"m.{value}").alias(value))


def rate_limit_schedule(events: DataFrame, key: str, t: str, tie: str, gap: float) -> DataFrame:
    """When each request of a key may go, requests keeping `gap` apart.

    The start of request k is max over j <= k of (t_j - j * gap) + k * gap: one window by key.
    """
    order = Window.partitionBy(key).orderBy(t, tie)
    k = F.row_number().over(order) - 1
    lead = F.max(F.col("__lag")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("__k", k).withColumn("__lag", F.col(t) - F.col("__k") * gap)
    rows = rows.withColumn("start", lead + F.col("__k") * gap)
    return rows.withColumn("wait", F.col("start") - F.col(t)).drop("__k", "__lag")


def sliding_limiter(events: DataFrame, key: str, t: str, tie: str, window: float, limit: int) -> DataFrame:
    """(key, t, tie, admitted): at most `limit` admitted requests within `window` seconds; refused ones
    leave no trace. Rows are sorted by key and time and pass one by one; what is held is the last
    `limit` admitted times of one key, however many rows it has."""

    def admit(batches):
        now, live = None, deque()
        for b in batches:
            out = []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != now:
                    now, live = k, deque()
                while live and x - live[0] > window:
                    live.popleft()
                out.append(len(live) < limit)
                if out[-1]:
                    live.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "admitted"])

    rows = events.select(key, F.col(t).cast("double").alias(t), tie)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", admitted boolean"
    return rows.repartition(key).sortWithinPartitions(key, t, tie).mapInArrow(admit, schema)


def settle(events: DataFrame, key: str, t: str, quiet: float = 1.0, cap: float = 8.0) -> DataFrame:
    """(key, start, settled, timed_out): the first quiet time after a key's first event, or the cap."""
    order = Window.partitionBy(key).orderBy(t)
    rows = events.select(key, t).withColumn("next", F.lead(t).over(order)).withColumn("first", F.min(t).over(Window.partitionBy(key)))
    still = F.col("next").isNull() | (F.col("next") - F.col(t) >= quiet)
    ends = rows.where(still).groupBy(key).agg(F.min("first").alias("start"), F.min(F.col(t) + quiet).alias("quiet_at"))
    return ends.select(key, "start", F.least("quiet_at", F.col("start") + cap).alias("settled"), (F.col("quiet_at") > F.col("start") + cap).alias("timed_out"))


def settle_with_requests(events: DataFrame, key: str, t: str, kind: str, request: str, quiet: float = 1.0, cap: float = 8.0, tie: str | None = None) -> DataFrame:
    """(key, start, settled, timed_out): the first time that nothing has happened for `quiet` seconds
    and no request is open, or the cap. Open requests are a set: a second start counts once."""
    ties = [tie] if tie else []
    by_request, by_key = Window.partitionBy(key, request).orderBy(t, *ties), Window.partitionBy(key).orderBy(t, *ties)
    is_open = F.when(F.col(kind) == "started", 1).otherwise(0)
    rows = events.select(key, t, *ties, request, is_open.alias("__open"))
    rows = rows.withColumn("__step", F.col("__open") - F.coalesce(F.lag("__open").over(by_request), F.lit(0)))
    rows = rows.withColumn("__busy", F.sum("__step").over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("__next", F.lead(t).over(by_key)).withColumn("__first", F.min(t).over(Window.partitionBy(key)))
    still = (F.col("__busy") == 0) & (F.col("__next").isNull() | (F.col("__next") - F.col(t) >= quiet))
    ends = rows.groupBy(key).agg(F.min("__first").alias("start"), F.min(F.when(still, F.col(t) + quiet)).alias("quiet_at"))
    limit = F.col("start") + cap
    late = F.coalesce(F.col("quiet_at") > limit, F.lit(True))
    return ends.select(key, "start", F.when(late, limit).otherwise(F.col("quiet_at")).alias("settled"), late.alias("timed_out"))


def main_responses(responses: DataFrame, request: str = "request_id", loader: str = "loader_id", frame: str = "frame_id", top: str = "top_frame_id") -> DataFrame:
    """Responses of main resources: the request is its own loader, in the top frame."""
    return responses.where((F.col(request) == F.col(loader)) & (F.col(frame) == F.col(top)))


def graded(rows: DataFrame, by: list[str], passed: str) -> DataFrame:
    """(by, graded, failed, ungraded) of a verdict that may be missing: null is neither passed nor failed."""
    c = F.col(passed)
    counts = [F.count_if(c.isNotNull()).alias("graded"), F.count_if(c == F.lit(False)).alias("failed"), F.count_if(c.isNull()).alias("ungraded")]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def by_deadline(rows: DataFrame, elapsed: str, deadline: float = 90.0) -> DataFrame:
    """Partial results stay; what took longer has status timeout."""
    return rows.withColumn("status", F.when(F.col(elapsed) <= deadline, "done").otherwise("timeout"))
