"""Continuous event summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_summary_stream(events: DataFrame, moment: str, dimensions: list[str], duration: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and durations per time window and dimension values.

    State holds one small aggregate per open window and group; the watermark closes windows and lets
    ``append`` output emit each of them once.
    """
    grouped = events.withWatermark(moment, delay).groupBy(F.window(moment, window).alias("w"), *dimensions)
    return grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.bround(F.avg(duration), 3).alias("average"),
        F.bround(F.min(duration), 3).alias("least"),
        F.bround(F.max(duration), 3).alias("greatest"),
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *dimensions, "total", "average", "least", "greatest")
