"""Streams of events: tumbling and session windows of event time, late rows dropped behind a watermark."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet files in a folder, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, *, time: str, keys: list[str], value: str, size: str, late: str) -> DataFrame:
    """(start, end, keys, n, total) of windows; a window comes out once the watermark has passed it, later rows are dropped."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, *, time: str, keys: list[str], value: str, gap: str, late: str) -> DataFrame:
    """(start, end, keys, n, total) of runs of a key's rows with gaps below `gap`; a run comes out once the watermark has passed its end."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
