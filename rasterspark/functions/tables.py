"""Table functions: read_cog, read_stac, read_stac_search, cog_version, cog_cache_stats, cog_io_bench."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

import rasterspark
from rasterspark.functions import bench, cache, engine
from rasterspark.functions.model import RasterError, pack_key, unpack_key
from rasterspark.functions.types import spark_schema
from rasterspark.sources import stac

TILES = "id bigint, level int, tile_x int, tile_y int, cols int, rows int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, crs string"
CACHE = "hits bigint, misses bigint, evictions bigint, bytes bigint, max_bytes bigint"


def _box(bbox) -> list[float] | None:
    if bbox is None:
        return None
    if len(bbox) != 4:
        raise RasterError(f"read_cog: bbox must have exactly 4 elements [xmin, ymin, xmax, ymax], got {len(bbox)}")
    return [float("nan") if v is None else float(v) for v in bbox]


class ReadCog:
    """Tiles of all levels of a file; with a box, those that touch it."""

    @staticmethod
    def analyze(path: AnalyzeArgument, bbox: AnalyzeArgument | None = None) -> AnalyzeResult:
        if path.isConstantExpression and path.value is not None:
            engine.Opener()(path.value)  # a missing file is an error of the query, not of a task
        return AnalyzeResult(spark_schema(TILES))

    def eval(self, path, bbox=None) -> Iterator[tuple]:
        if path is None:
            return
        try:
            yield from engine.Opener()(path).meta.tiles(_box(bbox))
        except RasterError as e:
            raise RasterError(f"read_cog: '{path}': {e}") from e


class ReadStac:
    """Items and assets of a document."""

    def eval(self, url) -> Iterator[tuple]:
        if url is not None:
            yield from stac.read_document(url)


class ReadStacSearch:
    """Items and assets of a search, over all its pages."""

    def eval(self, url, collections=None, bbox=None, datetime=None, page_size=None, max_rows=None) -> Iterator[tuple]:
        if url is not None:
            yield from stac.search(url, collections, bbox, datetime, page_size, max_rows)


class Version:
    def eval(self) -> Iterator[tuple]:
        if unpack_key(pack_key(3, 5, 7)) != (3, 5, 7):
            raise AssertionError("tile key does not round-trip")
        yield (rasterspark.__version__,)


class CacheStats:
    """Counters of the tile cache of the worker that answers; all 0 if it is off."""

    def eval(self) -> Iterator[tuple]:
        yield tuple(cache.tiles.stats().values())


class IoBench:
    def eval(self, path, io="auto") -> Iterator[tuple]:
        yield from bench.workload(path, io or "auto")


def functions() -> dict:
    return {
        "read_cog": udtf(ReadCog),
        "read_stac": udtf(ReadStac, returnType=stac.SCHEMA),
        "read_stac_search": udtf(ReadStacSearch, returnType=stac.SCHEMA),
        "cog_version": udtf(Version, returnType="version string"),
        "cog_cache_stats": udtf(CacheStats, returnType=CACHE),
        "cog_io_bench": udtf(IoBench, returnType="metric string, value double"),
    }


def register(spark: SparkSession) -> None:
    for name, function in functions().items():
        spark.udtf.register(name, function)


def cache_stats(spark: SparkSession, slots: int | None = None) -> DataFrame:
    """Counters of the tile caches of the workers that a job of `slots` tasks meets, one row each."""
    n = slots or spark.sparkContext.defaultParallelism

    def run(batches):
        import os

        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pylist([{"pid": os.getpid(), **cache.tiles.stats()}])

    return spark.range(n, numPartitions=n).mapInArrow(run, f"pid bigint, {CACHE}").dropDuplicates(["pid"])


def configure_caches(spark: SparkSession, *, tile_mb: float | None = None, ttl_s: float | None = None) -> dict[str, str | None]:
    """Set the size of the tile caches and the life of opened rasters for Python workers started from now on; what they were.

    0 turns a cache off, None leaves it. Workers are told apart by their settings, so those of before are not used again; giving what
    was returned as `restore_caches` does brings them back.
    """
    env = spark.sparkContext.environment
    old = {name: env.get(name) for name in ("COG_TILE_CACHE_MB", "COG_REMOTE_CACHE_TTL_S")}
    for name, value in zip(old, (tile_mb, ttl_s), strict=True):
        if value is not None:
            if value < 0:
                raise ValueError(f"{name} must not be negative")
            env[name] = str(value)
    return old


def restore_caches(spark: SparkSession, old: dict[str, str | None]) -> None:
    """Undo `configure_caches`."""
    env = spark.sparkContext.environment
    for name, value in old.items():
        if value is None:
            env.pop(name, None)
        else:
            env[name] = value
