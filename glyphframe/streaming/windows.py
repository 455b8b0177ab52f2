"""Structured Streaming over timed events: runs without long gaps, and profiles of fixed windows, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    """With the time as a timestamp, which watermarks need."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def runs(events: DataFrame, key: str, at: str = "ts", gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): a key's events with at most so long between them; events that come too late are dropped."""
    by = timed(events, at).withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def profiles(events: DataFrame, key: str, value: str, at: str = "ts", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, start, n, mean, variance) of each window; sliding windows overlap."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    by = timed(events, at).withWatermark(at, late).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    return by.select(key, F.col("w.start").alias("start"), "n", "mean", "variance")
