"""Event-time windows, the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """(day, event_type, events, users, value) by tumbling window; ``late`` sets a watermark on a stream.

    On a stream distinct users are approximate, for exact ones need every user
    kept; a window comes out once the watermark has passed it, so the period that
    is still open is left out.
    """
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "0 seconds")
        users = F.approx_count_distinct("user_id", 0.01)
    else:
        users = F.count_distinct("user_id")
    g = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), users.alias("users"), F.round(F.sum("value"), 4).alias("value"))
    return g.select(F.col("w.start").alias("day"), "event_type", "events", "users", "value")
