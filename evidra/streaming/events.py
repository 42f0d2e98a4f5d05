"""Streaming extension: windowed event totals with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_totals(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) of a stream or a table of (ts, event_type, value).

    Times without a zone are taken in the session's zone when streaming. Sums are of decimals, so they do not depend on the order of rows.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    totals = rows.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return totals.select(F.col("window.start").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))
