"""Windowed aggregates that run alike on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum by type in tumbling (or sliding) windows; rows later than `late` are dropped by a stream."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row for each user's run of events with no gap longer than `gap`."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
