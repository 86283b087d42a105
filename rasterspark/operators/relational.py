"""Plans for many points, zones and rasters.

Rows are dealt by the tile that they need, so a tile is read and decoded once for a task whatever number
of rows it serves, and one large raster is spread over tasks. `salt` deals the rows of one tile over so
many tasks; a tile that holds a large part of all rows is then read up to `salt` times but holds up none.
Partial results of a zone are merged by ordinary sums and extremes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from rasterspark.functions import engine
from rasterspark.functions.register import UDFS
from rasterspark.functions.types import arrow_type, spark_type
from rasterspark.functions.zone import parse
from rasterspark.plans import grid
from rasterspark.session import Scratch

SALT = 4
BROADCAST_PATHS = 20_000  # of about 200 bytes each
GRID = "array<struct<level:int,width:int,height:int,tile_width:int,tile_height:int>>"
META = f"struct<levels:{GRID},bands:int,origin_x:double,origin_y:double,pixel_x:double,pixel_y:double,crs:string>"


@arrow_udf(spark_type(META))
def raster_meta(path: pa.Array) -> pa.Array:
    """Levels and georeference of each path; the file is opened, no pixel is read."""
    paths = path.to_pylist()
    found, out = engine.metas(paths), []
    for p in paths:
        if p is None:
            out.append(None)
            continue
        meta = found[p]
        g = meta.georef
        levels = [{"level": k, "width": t.width, "height": t.height, "tile_width": t.tile_width, "tile_height": t.tile_height} for k, t in enumerate(meta.levels)]
        out.append({"levels": levels, "bands": meta.bands, "origin_x": g and g.origin_x, "origin_y": g and g.origin_y, "pixel_x": g and g.pixel_x, "pixel_y": g and g.pixel_y, "crs": meta.crs})
    return pa.array(out, arrow_type(META))


@arrow_udf(spark_type("array<double>"))
def zone_envelope(wkt: pa.Array) -> pa.Array:
    """Envelope of each WKT zone; null for an empty one."""
    return pa.array([None if t is None else parse(t).envelope() for t in wkt.to_pylist()], pa.list_(pa.float64()))


def with_meta(rows: DataFrame, path: str = "path") -> DataFrame:
    """Add `meta`; each distinct path is opened once, by one task.

    The paths' metadata is written first. Up to BROADCAST_PATHS of them go to every task, so the rows, of which one path may have all,
    are not shuffled; more are joined with each path's rows spread over SALT parts.
    """
    scratch = Scratch(rows.sparkSession, "metadata")
    metas = rows.select(F.col(path).alias("__of")).where("__of IS NOT NULL").distinct().withColumn("meta", raster_meta("__of"))
    metas = scratch.table(metas, "metas")
    if metas.count() <= BROADCAST_PATHS:
        return rows.join(F.broadcast(metas), F.col(path) == F.col("__of"), "left").drop("__of")
    parts = metas.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = rows.withColumn("__deal", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    return dealt.join(parts, (F.col(path) == F.col("__of")) & (F.col("__deal") == F.col("__part")), "left").drop("__of", "__part", "__deal")


def _column_of(x: Column) -> Column:
    return grid.pixel_of(x, F.col("meta.origin_x"), F.col("meta.pixel_x"), 1)


def _row_of(y: Column) -> Column:
    return grid.pixel_of(y, F.col("meta.origin_y"), F.col("meta.pixel_y"), -1)


def _georeferenced(value: Column, needed: Column) -> Column:
    """`value`, or an error where a raster without georeference is needed."""
    missing = F.col("meta").isNotNull() & F.col("meta.origin_x").isNull() & needed
    return F.when(missing, F.raise_error(F.lit("raster has no georeference")).cast("long")).otherwise(value)


def world_to_raster(points: DataFrame, *, path: str = "path", x: str = "x", y: str = "y", col: str = "col", row: str = "row") -> DataFrame:
    """Add the 1-based column and row of each point, as RS_WorldToRasterCoord gives them, by column arithmetic."""
    ax, ay = F.col(x).cast("double"), F.col(y).cast("double")
    whole = ax.isNotNull() & ay.isNotNull()
    rows = with_meta(points.drop(col, row), path).withColumn("__c", _georeferenced(_column_of(ax), whole)).withColumn("__r", _row_of(ay))
    least, most = -(1 << 31) - 1, (1 << 31) - 2  # 0-based cells whose 1-based numbers are ints
    fits = ~F.isnan(ax) & ~F.isnan(ay) & F.col("__c").between(least, most) & F.col("__r").between(least, most)
    return rows.withColumn(col, F.when(fits, F.col("__c") + 1).cast("int")).withColumn(row, F.when(fits, F.col("__r") + 1).cast("int")).drop("meta", "__c", "__r")


def raster_to_world(cells: DataFrame, *, path: str = "path", col: str = "col", row: str = "row", x: str = "x", y: str = "y") -> DataFrame:
    """Add the coordinates of the upper left corner of each 1-based cell, as RS_RasterToWorldCoord gives them, by column arithmetic."""
    whole = F.col(col).isNotNull() & F.col(row).isNotNull()
    rows = with_meta(cells.drop(x, y), path).withColumn("__c", _georeferenced(F.col(col).cast("long"), whole))
    at_x = F.col("meta.origin_x") + (F.col("__c") - 1) * F.col("meta.pixel_x")
    at_y = F.col("meta.origin_y") - (F.col(row) - 1) * F.col("meta.pixel_y")
    return rows.withColumn(x, F.when(whole, at_x)).withColumn(y, F.when(whole, at_y)).drop("meta", "__c")


def tiles(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row for each tile of all levels of each path, by exploding two sequences."""
    level = paths.select(path).withColumn("meta", raster_meta(path)).select(path, "meta", F.explode("meta.levels").alias("l"))
    number = lambda n, size: F.ceil(F.col(n) / F.col(size)).cast("int") - 1
    rows = level.select(path, "meta", "l", F.explode(F.sequence(F.lit(0), number("l.height", "l.tile_height"))).alias("tile_y"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), number("l.width", "l.tile_width"))).alias("tile_x"))
    top, has = F.element_at("meta.levels", 1), F.col("meta.origin_x").isNotNull()
    px, py = F.col("meta.pixel_x") * (top["width"] / F.col("l.width")), F.col("meta.pixel_y") * (top["height"] / F.col("l.height"))
    left, above = F.col("tile_x") * F.col("l.tile_width"), F.col("tile_y") * F.col("l.tile_height")
    right, below = F.least(left + F.col("l.tile_width"), F.col("l.width")), F.least(above + F.col("l.tile_height"), F.col("l.height"))
    ox, oy = F.col("meta.origin_x"), F.col("meta.origin_y")
    box = F.when(has, F.struct((ox + left * px).alias("xmin"), (oy - below * py).alias("ymin"), (ox + right * px).alias("xmax"), (oy - above * py).alias("ymax")))
    key = grid.pack_key(F.col("l.level"), F.col("tile_x"), F.col("tile_y"))
    return rows.select(path, key.alias("id"), F.col("l.level").alias("level"), "tile_x", "tile_y", F.col("l.tile_width").alias("cols"), F.col("l.tile_height").alias("rows"), box.alias("bbox"), F.col("meta.crs").alias("crs"))


def _dealt(rows: DataFrame, keys: Sequence[str], salt: int, spread: Column) -> DataFrame:
    return rows.withColumn("__salt", F.pmod(spread, F.lit(max(1, salt)))).repartition(*keys, "__salt").sortWithinPartitions(*keys).drop("__salt")


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple[tuple, int, int]]:
    """Runs of equal values of some columns in a sorted batch."""
    columns = [batch.column(batch.schema.names.index(n)).to_pylist() for n in names]
    rows, a = list(zip(*columns, strict=True)), 0
    for b in range(1, len(rows) + 1):
        if b == len(rows) or rows[b] != rows[a]:
            yield rows[a], a, b
            a = b


class _Held:
    """The raster and the tile that a task is at, kept from batch to batch."""

    def __init__(self):
        self.path = self.raster = self.key = self.data = None

    def tile(self, path: str, x: int, y: int) -> tuple[engine.Raster, np.ndarray]:
        if path != self.path:
            self.path, self.raster, self.key = path, engine.Opener()(path), None
        if self.key != (x, y):
            self.key = (x, y)
            ((_, self.data),) = self.raster.tiles([(x, y)])
        return self.raster, self.data


def sample_bands(points: DataFrame, bands: Mapping[str, int], *, path: str = "path", x: str = "x", y: str = "y", salt: int = SALT) -> DataFrame:
    """Add a column for each name of `bands` with that band's value at each point; a tile is read once for all of them.

    Null arguments, bands that do not exist and points outside give null. A raster without georeference is
    an error.
    """
    rows = with_meta(points.drop(*bands), path)
    top, whole = F.element_at("meta.levels", 1), F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = rows.withColumn("__c", _georeferenced(_column_of(F.col(x).cast("double")), whole)).withColumn("__r", _row_of(F.col(y).cast("double")))
    inside = (F.col("__c") >= 0) & (F.col("__c") < top["width"]) & (F.col("__r") >= 0) & (F.col("__r") < top["height"])
    rows = rows.withColumn("__tx", F.when(inside, F.floor(F.col("__c") / top["tile_width"]))).withColumn("__ty", F.when(inside, F.floor(F.col("__r") / top["tile_height"]))).drop("meta")
    dealt = _dealt(rows, [path, "__ty", "__tx"], salt, F.xxhash64("__c", "__r"))
    kept = [f for f in dealt.schema.fields if f.name not in ("__c", "__r", "__tx", "__ty")]
    schema = StructType([*kept, *(StructField(name, DoubleType()) for name in bands)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            values, known = np.zeros((len(bands), batch.num_rows)), np.zeros((len(bands), batch.num_rows), bool)
            cols, rws = (batch.column(batch.schema.names.index(n)) for n in ("__c", "__r"))
            for (p, ty, tx), a, b in _runs(batch, (path, "__ty", "__tx")):
                if tx is None:
                    continue
                raster, tile = held.tile(p, tx, ty)
                at = np.s_[rws[a:b].to_numpy() - ty * raster.top.tile_height, cols[a:b].to_numpy() - tx * raster.top.tile_width]
                for k, band in enumerate(bands.values()):
                    if raster.has_band(band):
                        got = tile[band - 1][at].astype(float)
                        values[k, a:b], known[k, a:b] = got, raster.valid(got)
            columns = [batch.column(batch.schema.names.index(f.name)).cast(arrow.field(i).type) for i, f in enumerate(kept)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, mask=~k) for v, k in zip(values, known, strict=True))], schema=arrow)

    return dealt.mapInArrow(run, schema)


def sample_points(points: DataFrame, *, band: int = 1, value: str = "value", **options) -> DataFrame:
    """Add the pixel value at each point, as RS_Value gives it; all columns and rows are kept."""
    return sample_bands(points, {value: band}, **options)


PARTIAL = "count bigint, sum double, low double, high double"


def zonal_stats(zones: DataFrame, *, keys: Sequence[str], path: str = "path", zone: str = "zone", band: int = 1, salt: int = SALT) -> DataFrame:
    """(keys, count, sum, mean, min, max) of each zone of each raster, as RS_ZonalStats gives them.

    `zone` is WKT or an array [xmin, ymin, xmax, ymax]; `keys` name a row. Zones are cut along the tiles that
    they need: a partial row for each (zone, tile), then one aggregation by the keys. A zone without valid
    pixels has count 0 and nulls; a null path or zone has nulls only. Repeated keys are added up.
    """
    wkt = dict(zones.dtypes)[zone] == "string"
    rows = with_meta(zones.select(*keys, F.col(path).alias("__path"), F.col(zone).alias("__zone")), "__path")
    box = zone_envelope("__zone") if wkt else F.transform("__zone", lambda v: v.cast("double"))
    rows = rows.withColumn("__box", box).withColumn("__live", F.col("__path").isNotNull() & F.col("__zone").isNotNull())
    top, side = F.element_at("meta.levels", 1), lambda k: F.get("__box", F.lit(k))
    if not wkt:
        good = (F.size("__box") == 4) & (side(0) <= side(2)) & (side(1) <= side(3)) & (F.greatest(*(F.abs(side(k)) for k in range(4))) < float("inf"))
        whole = ~F.exists("__box", lambda v: v.isNull())
        rows = rows.withColumn("__live", F.col("__live") & whole)
        rows = rows.withColumn("__box", F.when(F.col("__live") & ~good, F.raise_error(F.lit("bbox must be finite with xmin <= xmax and ymin <= ymax")).cast("array<double>")).otherwise(F.col("__box")))
    ox, oy, px, py = (F.col(f"meta.{n}") for n in ("origin_x", "origin_y", "pixel_x", "pixel_y"))
    ox = F.when(F.col("__live") & F.col("meta.origin_x").isNull(), F.raise_error(F.lit("raster has no georeference")).cast("double")).otherwise(ox)
    rows = rows.withColumns({
        "__c0": grid.first_centre(side(0), ox, px, 1), "__c1": grid.last_centre(side(2), ox, px, 1, top["width"]),
        "__r0": grid.first_centre(side(3), oy, py, -1), "__r1": grid.last_centre(side(1), oy, py, -1, top["height"]),
    })
    seen = F.col("__live") & F.col("__box").isNotNull() & (F.lit(band) >= 1) & (F.lit(band) <= F.col("meta.bands")) & (F.col("__c0") <= F.col("__c1")) & (F.col("__r0") <= F.col("__r1"))
    tile_of = lambda at, size: F.floor(F.col(at) / top[size])
    rows = rows.withColumn("__ty", F.explode_outer(F.when(seen, grid.steps(tile_of("__r0", "tile_height"), tile_of("__r1", "tile_height")))))
    rows = rows.withColumn("__tx", F.explode_outer(F.when(seen, grid.steps(tile_of("__c0", "tile_width"), tile_of("__c1", "tile_width")))))
    dealt = _dealt(rows.select(*keys, "__path", "__zone", "__live", "__c0", "__c1", "__r0", "__r1", "__ty", "__tx"), ["__path", "__ty", "__tx"], salt, F.xxhash64(*keys))
    schema = StructType([dealt.schema[k] for k in keys] + StructType.fromDDL(f"live boolean, {PARTIAL}").fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            out = [engine.Stats() for _ in range(batch.num_rows)]
            texts, live = at["__zone"], at["__live"].to_pylist()
            windows = list(zip(*(at[n].to_pylist() for n in ("__c0", "__c1", "__r0", "__r1")), strict=True))
            for (p, ty, tx), a, b in _runs(batch, ("__path", "__ty", "__tx")):
                if tx is None:
                    continue
                raster, tile = held.tile(p, tx, ty)
                for i in range(a, b):
                    own = texts[i].as_py()
                    out[i].add(raster.tile_values((tx, ty), tile, parse(own) if wkt else own, engine.Window(*windows[i]), band))
            number = lambda v: None if v is None or np.isnan(v) else v
            columns = [at[k].cast(arrow.field(i).type) for i, k in enumerate(keys)]
            more = [pa.array(live), pa.array([s.count for s in out], pa.int64()), pa.array([s.sum for s in out], pa.float64()), pa.array([number(s.min) for s in out], pa.float64()), pa.array([number(s.max) for s in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, *more], schema=arrow)

    parts = dealt.mapInArrow(run, schema)
    merged = parts.groupBy(*keys).agg(F.max("live").alias("live"), F.sum("count").alias("n"), F.sum("sum").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    some, nan = F.col("n") > 0, F.lit(float("nan"))
    return merged.select(
        *keys, F.when(F.col("live"), F.col("n")).alias("count"), F.when(some, F.col("s")).alias("sum"), F.when(some, F.col("s") / F.col("n")).alias("mean"),
        F.when(some, F.coalesce("low", nan)).alias("min"), F.when(some, F.coalesce("high", nan)).alias("max"),
    )


def band_pixels(paths: DataFrame, *, path: str = "path", band: int = 1) -> DataFrame:
    """(path, row, col, value) of every pixel of a band, 0-based, null for nodata; a task decodes whole tiles."""
    wanted = tiles(paths, path).where("level = 0").select(path, "tile_y", "tile_x")
    dealt = wanted.repartition(path, "tile_y", "tile_x").sortWithinPartitions(path, "tile_y", "tile_x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            for (p, ty, tx), _, _ in _runs(batch, (path, "tile_y", "tile_x")):
                raster, tile = held.tile(p, tx, ty)
                if not raster.has_band(band):
                    continue
                top = raster.top
                part = raster.cut(engine.Window(0, top.width - 1, 0, top.height - 1), (tx, ty))
                values = raster.block((tx, ty), tile, part, band)
                rows, cols = np.mgrid[part.r0 : part.r1 + 1, part.c0 : part.c1 + 1]
                yield pa.RecordBatch.from_arrays([pa.array([p] * values.size, pa.string()), pa.array(rows.ravel().astype(np.int32)), pa.array(cols.ravel().astype(np.int32)), pa.array(values.ravel(), mask=~raster.valid(values).ravel())], names=["path", "row", "col", "value"])

    return dealt.mapInArrow(run, "path string, row int, col int, value double")


def normalized_difference(points: DataFrame, band1: int, band2: int, *, value: str = "nd", **options) -> DataFrame:
    """Add (v2 - v1) / (v2 + v1) at each point; null if a value is missing or the sum is 0."""
    rows = sample_bands(points.drop(value), {"__v1": band1, "__v2": band2}, **options)
    total = F.col("__v1") + F.col("__v2")
    return rows.withColumn(value, F.when(total != 0, (F.col("__v2") - F.col("__v1")) / total)).drop("__v1", "__v2")


__all__ = ["UDFS", "band_pixels", "normalized_difference", "raster_meta", "raster_to_world", "sample_bands", "sample_points", "tiles", "with_meta", "world_to_raster", "zonal_stats", "zone_envelope"]
