"""Detector flags on streams of events: late rows, windows and counts per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELAY = "2 hours"


def _bounded(events: DataFrame, delay: str) -> DataFrame:
    """A stream with its watermark, for which event times are zoned; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def flagged(events: DataFrame, bound: float, value: str = "value") -> DataFrame:
    """Events with ``flag``: whether the value exceeds the bound (null does not)."""
    return events.withColumn("flag", F.coalesce(F.col(value) > bound, F.lit(False)))


def windowed(events: DataFrame, length: str = "1 day", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """(start, event_type, n, n_flagged, worst) of tumbling or sliding windows of event time, from (ts, event_type, value, flag).

    On a stream, rows later than ``delay`` are dropped and a window is given once it has closed; on a
    table all windows are given.
    """
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _bounded(events, delay).groupBy(at.alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.count_if("flag").alias("n_flagged"), F.max("value").alias("worst")
    ).select(F.col("w.start").alias("start"), "event_type", "n", "n_flagged", "worst")


def sessions(events: DataFrame, gap: str = "6 hours", delay: str = DELAY) -> DataFrame:
    """(user_id, start, end, n, n_flagged): runs of a user's events with no gap of ``gap`` or longer."""
    found = _bounded(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.count_if("flag").alias("n_flagged"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_flagged")
