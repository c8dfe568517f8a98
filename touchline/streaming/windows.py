"""Streaming forms: windowed and sessioned counts with watermarks, and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; works on batches and streams alike. Later events than the watermark are dropped on streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(28,6)")).cast("double"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user; on streams, those still within the watermark aren't final."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)
