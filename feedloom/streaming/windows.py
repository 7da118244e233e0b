"""Event-time windows over streams and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant, not a local time: the column is read as UTC."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def counted(events: DataFrame, window, keys: list[str], late: str | None = None, column: str = "ts") -> DataFrame:
    rows = event_time(events, column)
    rows = rows.withWatermark(column, late) if late else rows
    out = rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "value")


def tumbling(events: DataFrame, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    return counted(events, F.window("ts", size), keys, late)


def sliding(events: DataFrame, size: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    return counted(events, F.window("ts", size, step), keys, late)


def sessions(events: DataFrame, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    return counted(events, F.session_window("ts", gap), keys, late)


def deduplicated(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """The first row of each key; state is dropped once the watermark passes."""
    return event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
