"""Exact duplicates among documents that arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_each_hash(stream: DataFrame, time_col: str = "arrived_at", delay: str = "1 day") -> DataFrame:
    """Of documents (package_id, text, time_col) with one content in a package only the first passes, within the watermark's delay."""
    hashed = stream.withColumn("sha", F.sha2("text", 256)).withWatermark(time_col, delay)
    return hashed.dropDuplicatesWithinWatermark(["package_id", "sha"])


def arrivals(stream: DataFrame, time_col: str = "arrived_at", window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Documents and bytes a package and window."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "package_id").agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).alias("bytes"))
