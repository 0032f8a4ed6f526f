"""Live capture events: change transitions, sessions and the streaming form of both."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def transitions(events: DataFrame, key: str = "user_id", signal: str = "event_type") -> DataFrame:
    """Events whose signal differs from the one before it of the same key, ordered by time and id."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    return events.withColumn("__before", F.lag(signal).over(w)).filter(F.col("__before").isNull() | (F.col("__before") != F.col(signal))).drop("__before")


def sessions(events: DataFrame, key: str = "user_id", gap_seconds: int = 600) -> DataFrame:
    """(key, ``session_start, session_end, n_events``): runs of events less than ``gap_seconds`` apart.

    Works on a stream with a watermark on ``ts`` as on a table. A session ends ``gap_seconds`` after its last event.
    """
    # Spark joins an event that comes exactly when a window ends, so the window is a microsecond shorter
    held = events.groupBy(F.session_window("ts", f"{gap_seconds * 1_000_000 - 1} microseconds").alias("w"), key).agg(F.count("*").alias("n_events"))
    return held.select(key, F.col("w.start").alias("session_start"), (F.col("w.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("session_end"), "n_events")


def windowed_counts(events: DataFrame, signal: str = "event_type", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(``start``, signal, ``n, total``) by fixed windows; on a stream, windows close ``lateness`` after their end."""
    late = events.withWatermark("ts", lateness) if events.isStreaming else events
    held = late.groupBy(F.window("ts", width).alias("w"), signal).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return held.select(F.col("w.start").alias("start"), signal, "n", "total")


def stream_transitions(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The streaming form of ``transitions``: the last signal of a user is state, dropped an hour after its watermark passes."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        before = rows["event_type"].shift(1)
        before.iloc[0] = last
        kept = rows[rows["event_type"] != before]
        state.update((rows["event_type"].iloc[-1],))
        state.setTimeoutTimestamp(int(rows["ts"].max().timestamp() * 1000) + 3_600_000)
        yield kept[["user_id", "event_id", "ts", "event_type"]]

    out = "user_id long, event_id long, ts timestamp, event_type string"
    rows = events.select("user_id", "event_id", "ts", "event_type").withWatermark("ts", lateness)
    return rows.groupBy("user_id").applyInPandasWithState(fold, out, "last string", "append", GroupStateTimeout.EventTimeTimeout)


def timeline(events: DataFrame, key: str = "user_id", signal: str = "event_type", short_seconds: float = 0.3) -> DataFrame:
    """(key, ``start, end``, signal): each state lasts until the next change; states shorter than ``short_seconds`` go, and equal
    neighbours merge. The last state of a key has no end and is left out."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    spans = transitions(events, key, signal).withColumn("end", F.lead("ts").over(w)).filter(F.col("end").isNotNull())
    long_enough = spans.filter(F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) >= int(short_seconds * 1e6))
    o = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.when((F.lag(signal).over(o) == F.col(signal)) & (F.lag("end").over(o) == F.col("ts")), 0).otherwise(1)
    run = long_enough.withColumn("__new", new).withColumn("__run", F.sum("__new").over(o))
    return run.groupBy(key, "__run").agg(F.min("ts").alias("start"), F.max("end").alias("end"), F.first(signal).alias(signal)).drop("__run")
