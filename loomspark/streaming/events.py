"""Event-time operators that take a stream or a batch of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events with ts as a timestamp and, on a stream, a watermark for late rows."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late)


def tumbling(events: DataFrame, width: str) -> DataFrame:
    """Count and sum of each window and event type."""
    return sliding(events, width, width)


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    out = timed(events).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """A user's events no further than gap apart: start, number and sum of each session."""
    out = timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("user_id", F.col("w.start").alias("start"), "n", "total")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    out = timed(events)
    return (out.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else out.dropDuplicates(["event_id"])).select("event_id", "event_type", "value")
