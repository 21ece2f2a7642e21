"""Extension: windows over event streams. The functions take batch or streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour", *keys: str) -> DataFrame:
    """Events and their value per window and keys; events later than `late` are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), *keys, "events", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Runs of a key's events with no pause as long as `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def first_seen(documents: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, within the watermark; for ingesting documents that may be delivered again."""
    return documents.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
