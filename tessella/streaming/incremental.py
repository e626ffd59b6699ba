"""Incremental aggregates: the sums behind pseudo-bulk and gene statistics are associative, so they also run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_bulk(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Sums and counts by ``keys``; for streams in update or complete mode."""
    return stream.groupBy(*keys).agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))


def windowed_bulk(stream: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """The same by tumbling event-time window; rows later than ``late`` are left out."""
    x = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return x.agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "value", "n")
