"""Streaming forms of the event operators: state per key, evicted with the watermark. C9.

Each takes a stream (or a table) with a key, a timestamp `ts` and an id, and sorts a key's rows
inside a micro-batch before it folds them. A key's state is bounded: one time for the rate
limit, `limit` times for the sliding window, two times for settling, one flag for the latch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _seconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") / 1_000_000


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    every = pd.concat(list(frames), ignore_index=True)
    return every.sort_values(["ts", "event_id"], kind="stable")


def _stream(events: DataFrame, late: str) -> DataFrame:
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return rows.withWatermark("ts", late)


def rate_limit_stream(events: DataFrame, gap: float = 5.0, late: str = "10 minutes") -> DataFrame:
    """events(key, ts, event_id) -> key, event_id, start, wait. The state goes after the gap."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = _sorted(frames)
        t = _seconds(rows["ts"])
        starts = []
        for x in t:
            last = x if last is None else max(x, last + gap)
            starts.append(last)
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + gap) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "start": starts, "wait": pd.Series(starts, index=rows.index) - t})

    kind = events.schema["key"].dataType.simpleString()
    return (
        _stream(events, late)
        .groupBy("key")
        .applyInPandasWithState(run, f"key {kind}, event_id bigint, start double, wait double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
    )


def sliding_limiter_stream(events: DataFrame, window: float = 3600.0, limit: int = 8, late: str = "10 minutes") -> DataFrame:
    """events(key, ts, event_id) -> key, event_id, admitted."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = _sorted(frames)
        out = []
        for x in _seconds(rows["ts"]):
            live = [h for h in live if x - h <= window]
            ok = len(live) < limit
            if ok:
                live.append(x)
            out.append(ok)
        state.update((live,))
        state.setTimeoutTimestamp(max(int((max(live, default=0.0) + window) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "admitted": out})

    kind = events.schema["key"].dataType.simpleString()
    return (
        _stream(events, late)
        .groupBy("key")
        .applyInPandasWithState(run, f"key {kind}, event_id bigint, admitted boolean", "live array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    )


def settle_stream(events: DataFrame, quiet: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Sessions of a key with gaps below `quiet`: key, start, settled. A session window."""
    rows = _stream(events, late)
    sessions = rows.groupBy("key", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return sessions.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("settled"), "events")


def in_flight_stream(events: DataFrame, late: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """events(key, ts, event_id, request, kind) -> key, event_id, busy: the open set's size after each event."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        open_ = dict.fromkeys(state.get[0]) if state.exists else {}
        rows = _sorted(frames)
        out = []
        for request, kind in zip(rows["request"], rows["kind"]):
            if kind == "started":
                open_[request] = None
            else:
                open_.pop(request, None)
            out.append(len(open_))
        state.update((list(open_),))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_ms)
        yield pd.DataFrame({"key": key[0], "event_id": rows["event_id"], "busy": out})

    kind = events.schema["key"].dataType.simpleString()
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), "event_id", "request", "kind").withWatermark("ts", late)
    return rows.groupBy("key").applyInPandasWithState(
        run, f"key {kind}, event_id bigint, busy bigint", "open array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def latch_stream(events: DataFrame, flag: str, late: str = "10 minutes", window: str = "1 day") -> DataFrame:
    """I4: whether a key has seen the flag, by window: a running or, merged in the tasks."""
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"), F.expr(flag).alias("flag")).withWatermark("ts", late)
    return rows.groupBy("key", F.window("ts", window).alias("w")).agg(F.bool_or("flag").alias("seen")).select("key", F.col("w.start").alias("since"), "seen")
