"""Streams of scenes: files that land in a folder, measured per zone and summed over event time."""

from __future__ import annotations

from collections.abc import Mapping

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rasterspark.functions.register import UDFS

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.tif", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, arrived) of the files in a folder; contents are not read."""
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger)
    return stream.load(folder).select("path", F.col("modificationTime").alias("arrived"))


def zone_stats(scenes: DataFrame, zones: Mapping[str, str], *, band: int = 1, path: str = "path") -> DataFrame:
    """Statistics of every zone (name to WKT, a parameter of the query) on every scene."""
    known = F.array(*(F.struct(F.lit(k).alias("zone_id"), F.lit(v).alias("zone")) for k, v in zones.items()))
    rows = scenes.withColumn("__zone", F.explode(known)).select(*scenes.columns, F.col("__zone.zone_id").alias("zone_id"), F.col("__zone.zone").alias("zone"))
    stats = UDFS["RS_ZonalStatsAll"](F.col(path), F.col("zone"), F.lit(band))
    return rows.withColumn("stats", stats).select(*scenes.columns, "zone_id", "stats.*")


def windowed(stats: DataFrame, *, time: str, late: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Scenes, pixels and mean of each zone in windows of event time; rows later than `late` are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = stats.withWatermark(time, late).groupBy(window.alias("window"), "zone_id")
    sums = grouped.agg(F.count(F.lit(1)).alias("scenes"), F.sum("count").alias("pixels"), F.sum("sum").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "zone_id", "scenes", "pixels", (F.col("total") / F.col("pixels")).alias("mean"), "min", "max")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write what is there as Parquet, then stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
