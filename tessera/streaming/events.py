"""Structured Streaming forms: windowed counts, distinct keys and recency over event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are left out once the watermark has passed."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width).alias("window"), *by).agg(F.count("*").alias("n")).select("window.start", "window.end", *by, "n")


def unseen(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark, in a stream or a batch."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp"))
    if not events.isStreaming:
        return timed.dropDuplicates(keys).drop("_t")
    return timed.withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def recent(events: DataFrame, time: str, now: Column, window: str) -> DataFrame:
    """Rows not older than ``window`` before ``now``; the clock is a parameter, so reruns agree."""
    return events.where(F.col(time) >= now - F.expr(f"INTERVAL {window}"))
