"""Registered queries of the raster and catalogue operators, each with the same result in plain SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

import rasterspark
from rasterspark import eventgrid, loopback
from rasterspark.functions import cache, engine, tables
from rasterspark.functions.register import register
from rasterspark.operators import relational
from rasterspark.plans import grid
from rasterspark.session import Scratch
from rasterspark.streaming import scenes as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(spark)
            return run(spark, sf_dir)

        QUERIES[run.__name__] = prepared
        if oracle:
            ORACLE[run.__name__] = oracle
        return prepared

    return add


def _on_grid(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL with {f} as the event grid's path and {sf_dir}'s tables as views."""
    for name in ("events", "customer", "nation", "part"):
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql.replace("{f}", f"'{eventgrid.event_grid(spark, sf_dir)}'"))


def rounded(x: str, digits: int) -> str:
    """round(x, digits) on doubles as the SQL has it, by a multiplication; Spark's own goes by the decimals of the shortest text."""
    return f"(round({x} * 1e{digits}D) / 1e{digits}D)"


#: Pixels of the event grid with their centres, and the grid's height.
PX = """px AS (SELECT CAST(event_id % 100 AS INTEGER) AS c, CAST(event_id // 100 AS INTEGER) AS r, CAST(round(value * 100) AS DOUBLE) AS v1, CAST(user_id AS DOUBLE) AS v2, event_type, event_id,
  1000 + (event_id % 100 + 0.5) * 10 AS x, 100000 - (event_id // 100 + 0.5) * 10 AS y FROM events),
dim AS (SELECT CAST(ceil(count(*) / 100.0) AS BIGINT) AS h FROM events)"""
TILES = """levels AS (SELECT 0 AS level, CAST(100 AS BIGINT) AS w, h AS lh, h FROM dim UNION ALL SELECT 1, 50, (h + 1) // 2, h FROM dim),
tiles AS (SELECT level, CAST(tx AS INTEGER) AS tile_x, CAST(ty AS INTEGER) AS tile_y, w, lh, 10 * (100.0 / w) AS sx, 10 * (h * 1.0 / lh) AS sy
  FROM levels, generate_series(0, 40000) AS a(ty), generate_series(0, 3) AS b(tx) WHERE tx * 32 < w AND ty * 32 < lh),
grid AS (SELECT (CAST(level AS BIGINT) << 48) | (CAST(tile_x AS BIGINT) << 24) | CAST(tile_y AS BIGINT) AS id, CAST(level AS INTEGER) AS level, tile_x, tile_y, CAST(32 AS INTEGER) AS cols, CAST(32 AS INTEGER) AS "rows",
  1000 + tile_x * 32 * sx AS xmin, 100000 - least(tile_y * 32 + 32, lh) * sy AS ymin, 1000 + least(tile_x * 32 + 32, w) * sx AS xmax, 100000 - tile_y * 32 * sy AS ymax, 'EPSG:32652' AS crs FROM tiles)"""
_TILE_COLUMNS = "id, level, tile_x, tile_y, cols, rows, bbox.xmin AS xmin, bbox.ymin AS ymin, bbox.xmax AS xmax, bbox.ymax AS ymax, crs"
_BOX = "xmin <= 1500 AND xmax >= 1100 AND ymin <= 99950 AND ymax >= 99850"


@query(f"WITH {PX}, {TILES} SELECT * FROM grid")
def read_cog_tiles(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT {_TILE_COLUMNS} FROM read_cog({{f}})")


@query(f"WITH {PX}, {TILES} SELECT * FROM grid WHERE {_BOX}")
def read_cog_bbox(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT {_TILE_COLUMNS} FROM read_cog({{f}}, bbox => array(1100.0, 99850.0, 1500.0, 99950.0))")


@query(f"WITH {PX}, {TILES} SELECT level, count(*) AS n, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin FROM grid GROUP BY level")
def read_cog_level_summary(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT level, count(*) AS n, min(bbox.xmin) AS xmin, max(bbox.xmax) AS xmax, min(bbox.ymin) AS ymin FROM read_cog({f}) GROUP BY level")


@query(f"WITH {PX}, {TILES} SELECT * FROM grid WHERE level = 0 AND {_BOX}")
def cog_source_pushdown(spark, sf_dir):
    rows = spark.read.format("cog").load(eventgrid.event_grid(spark, sf_dir))
    return rows.where("level = 0 AND bbox.xmin <= 1500 AND bbox.xmax >= 1100 AND bbox.ymin <= 99950 AND bbox.ymax >= 99850").selectExpr(*_TILE_COLUMNS.split(", "))


@query(f"WITH {PX}, {TILES} SELECT * FROM grid")
def tiles_relational(spark, sf_dir):
    paths = spark.createDataFrame([(eventgrid.event_grid(spark, sf_dir),)], "path string")
    return relational.tiles(paths).selectExpr(*_TILE_COLUMNS.split(", "))


@query(
    "WITH k AS (SELECT p_partkey, (CAST(p_size % 8 AS BIGINT) << 48) | (((p_partkey * 7919) % 16777216) << 24) | p_partkey AS tile_key FROM part) "
    "SELECT p_partkey, tile_key, CAST(tile_key >> 48 AS INTEGER) AS level, CAST((tile_key >> 24) & 16777215 AS INTEGER) AS tile_x, CAST(tile_key & 16777215 AS INTEGER) AS tile_y FROM k"
)
def tile_key_pack_unpack(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    keyed = part.select("p_partkey", grid.pack_key(F.col("p_size") % 8, (F.col("p_partkey") * 7919) % (1 << 24), F.col("p_partkey")).alias("tile_key"))
    level, x, y = grid.unpack_key(F.col("tile_key"))
    return keyed.select("p_partkey", "tile_key", level.alias("level"), x.alias("tile_x"), y.alias("tile_y"))


@query(f"WITH {PX} SELECT 1000.0::DOUBLE AS upperleftx, 100000.0::DOUBLE AS upperlefty, 100::INTEGER AS width, h::INTEGER AS height, 10.0::DOUBLE AS scalex, -10.0::DOUBLE AS scaley, 0.0::DOUBLE AS skewx, 0.0::DOUBLE AS skewy, 32652::INTEGER AS srid, 2::INTEGER AS numbands FROM dim")
def rs_metadata(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT m.* FROM (SELECT RS_MetaData({f}) AS m)")


@query(f"WITH {PX} SELECT 100::INTEGER AS w, h::INTEGER AS h, 2::INTEGER AS n, 32652::INTEGER AS srid, 10.0::DOUBLE AS sx, -10.0::DOUBLE AS sy, 0.0::DOUBLE AS kx, 0.0::DOUBLE AS ky, 1000.0::DOUBLE AS ux, 100000.0::DOUBLE AS uy FROM dim")
def rs_accessors(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT RS_Width(f) AS w, RS_Height(f) AS h, RS_NumBands(f) AS n, RS_SRID(f) AS srid, RS_ScaleX(f) AS sx, RS_ScaleY(f) AS sy, RS_SkewX(f) AS kx, RS_SkewY(f) AS ky, RS_UpperLeftX(f) AS ux, RS_UpperLeftY(f) AS uy FROM (SELECT {f} AS f)")


@query("SELECT '10.000000|0.000000|0.000000|-10.000000|1000.000000|100000.000000' AS geo")
def rs_georeference(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT replace(RS_GeoReference({f}), char(10), '|') AS geo")


@query("SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c, true AS d")
def rs_nodata(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT RS_BandNoDataValue(f) AS a, RS_BandNoDataValue(f, 1) AS b, RS_BandNoDataValue(f, 2) AS c, RS_BandNoDataValue(f, 3) IS NULL AS d FROM (SELECT {f} AS f)")


@query(f"WITH {PX}, v AS (SELECT 1 AS band, v1 AS v FROM px UNION ALL SELECT 2, v2 FROM px) SELECT band::INTEGER AS band, min(v) AS lo, max(v) AS hi, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd FROM v WHERE v <> 0 GROUP BY band")
def band_stats(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT band, s.min AS lo, s.max AS hi, {rounded('s.mean', 4)} AS mean, {rounded('s.stddev', 4)} AS sd FROM (SELECT band, RS_BandStats({{f}}, band) AS s FROM VALUES (1), (2) AS t(band))")


@query("SELECT c_custkey, CAST(floor((1000 + c_custkey * 7.25::DOUBLE - 1000) / 10) + 1 AS INTEGER) AS col, CAST(floor((100000 - (100000 - c_custkey * 3.125::DOUBLE)) / 10) + 1 AS INTEGER) AS row_nr FROM customer")
def rs_world_to_raster(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT c_custkey, w.col AS col, w.row AS row_nr FROM (SELECT c_custkey, RS_WorldToRasterCoord({f}, 1000 + c_custkey * 7.25D, 100000 - c_custkey * 3.125D) AS w FROM customer)")


@query("SELECT c_custkey, 1000.0::DOUBLE + (c_custkey - 1) * 10.0::DOUBLE AS x, 100000.0::DOUBLE - (c_nationkey - 1) * 10.0::DOUBLE AS y FROM customer")
def rs_raster_to_world(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT c_custkey, w.x AS x, w.y AS y FROM (SELECT c_custkey, RS_RasterToWorldCoord({f}, c_custkey, c_nationkey) AS w FROM customer)")


_POINT = "1000 + (event_id % 100 + 0.5D) * 10, 100000 - (event_id DIV 100 + 0.5D) * 10"


@query(f"WITH {PX} SELECT event_id, nullif(v1, 0) AS v FROM px")
def rs_value(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT event_id, RS_Value({{f}}, {_POINT}) AS v FROM events")


@query(f"WITH {PX} SELECT event_id, nullif(v2, 0) AS v FROM px")
def rs_value_band2(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT event_id, RS_Value({{f}}, {_POINT}, 2) AS v FROM events")


@query("SELECT CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, count(*) AS n FROM events")
def rs_value_outside(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT count(RS_Value({{f}}, event_id + 2000, 0.0)) AS a, count(RS_Value({{f}}, {_POINT}, 3)) AS b, count(*) AS n FROM events")


@query(f"WITH {PX} SELECT r, c AS at, nullif(v1, 0) AS v FROM px")
def rs_values(spark, sf_dir):
    rows = "SELECT CAST(event_id DIV 100 AS INT) AS r, sort_array(collect_list(CAST(event_id % 100 AS INT))) AS cs FROM events GROUP BY 1"
    points = "SELECT r, arrays_zip(cs, vs) AS z FROM (SELECT r, cs, RS_Values({f}, transform(cs, c -> 1000 + (c + 0.5D) * 10), transform(cs, c -> 100000 - (r + 0.5D) * 10)) AS vs FROM (" + rows + "))"
    return _on_grid(spark, sf_dir, f"SELECT r, p.cs AS at, p.vs AS v FROM (SELECT r, explode(z) AS p FROM ({points}))")


@query(f"WITH {PX} SELECT event_id, CASE WHEN v1 <> 0 AND v2 <> 0 THEN round((v2 - v1) / (v2 + v1), 9) END AS nd FROM px")
def rs_normalized_difference(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT event_id, {rounded('nd', 9)} AS nd FROM (SELECT event_id, RS_NormalizedDifference({{f}}, {_POINT}, 1, 2) AS nd FROM events)")


@query(f"WITH {PX} SELECT event_id, nullif(v1, 0) AS v FROM px")
def sample_points_relational(spark, sf_dir):
    points = _on_grid(spark, sf_dir, "SELECT event_id, {f} AS path, 1000 + (event_id % 100 + 0.5D) * 10 AS x, 100000 - (event_id DIV 100 + 0.5D) * 10 AS y FROM events")
    return relational.sample_points(points, value="v").select("event_id", "v")


@query(f"WITH {PX} SELECT event_id, CASE WHEN v1 <> 0 AND v2 <> 0 THEN round((v2 - v1) / (v2 + v1), 9) END AS nd FROM px")
def normalized_difference_relational(spark, sf_dir):
    points = _on_grid(spark, sf_dir, "SELECT event_id, {f} AS path, 1000 + (event_id % 100 + 0.5D) * 10 AS x, 100000 - (event_id DIV 100 + 0.5D) * 10 AS y FROM events")
    return relational.normalized_difference(points, 1, 2).select("event_id", F.expr(rounded("nd", 9)).alias("nd"))


@query(
    "SELECT c_custkey, CAST(floor((c_custkey * 7.25::DOUBLE) / 10) + 1 AS INTEGER) AS col, CAST(floor((c_custkey * 3.125::DOUBLE) / 10) + 1 AS INTEGER) AS row_nr, "
    "1000.0::DOUBLE + (c_custkey - 1) * 10.0::DOUBLE AS cx, 100000.0::DOUBLE - (c_nationkey - 1) * 10.0::DOUBLE AS cy FROM customer"
)
def coordinates_relational(spark, sf_dir):
    rows = _on_grid(spark, sf_dir, "SELECT c_custkey, CAST(c_custkey AS INT) AS c, c_nationkey AS r, {f} AS path, 1000 + c_custkey * 7.25D AS x, 100000 - c_custkey * 3.125D AS y FROM customer")
    cells = relational.world_to_raster(rows, row="row_nr")
    return relational.raster_to_world(cells, col="c", row="r", x="cx", y="cy").select("c_custkey", "col", "row_nr", "cx", "cy")


@query(f"WITH {PX} SELECT r AS row_nr, c AS col, nullif(v1, 0) AS v FROM px")
def band_pixels_relational(spark, sf_dir):
    paths = spark.createDataFrame([(eventgrid.event_grid(spark, sf_dir),)], "path string")
    return relational.band_pixels(paths).select(F.col("row").alias("row_nr"), "col", F.col("value").alias("v"))


# ------------------------------------------------------------------ zones
#: A box for each nation and a triangle for each nation; corners end in 3.7, so no centre lies on an edge.
_BOXES = "SELECT n_nationkey, array(1003.7D + n_nationkey * 31, 99503.7D + n_nationkey * 11, 1203.7D + n_nationkey * 37, 99903.7D + n_nationkey * 3) AS z FROM nation"
_BOX_ROWS = f"{PX}, z AS (SELECT n_nationkey, 1003.7::DOUBLE + n_nationkey * 31 AS a, 99503.7::DOUBLE + n_nationkey * 11 AS b, 1203.7::DOUBLE + n_nationkey * 37 AS c2, 99903.7::DOUBLE + n_nationkey * 3 AS d FROM nation), hit AS (SELECT n_nationkey, v1 AS v FROM z LEFT JOIN px ON x BETWEEN a AND c2 AND y BETWEEN b AND d AND v1 <> 0)"


def _zonal_query(stat: str, expression: str) -> None:
    def run(spark, sf_dir):
        return _on_grid(spark, sf_dir, f"SELECT n_nationkey, {rounded('v', 4) if stat == 'mean' else 'v'} AS v FROM (SELECT n_nationkey, RS_ZonalStats({{f}}, z, 1, '{stat}') AS v FROM ({_BOXES}))")

    run.__name__ = f"zonal_bbox_{stat}"
    query(f"WITH {_BOX_ROWS} SELECT n_nationkey, {expression} AS v FROM hit GROUP BY n_nationkey")(run)


for _stat, _expression in (("count", "count(v)::DOUBLE"), ("sum", "sum(v)"), ("mean", "round(avg(v), 4)"), ("min", "min(v)"), ("max", "max(v)")):
    _zonal_query(_stat, _expression)

_ALL = "count(v) AS n, sum(v) AS s, round(avg(v), 4) AS m, min(v) AS lo, max(v) AS hi"


@query(f"WITH {_BOX_ROWS} SELECT n_nationkey, {_ALL} FROM hit GROUP BY n_nationkey")
def zonal_bbox_all(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT n_nationkey, s.count AS n, s.sum AS s, {rounded('s.mean', 4)} AS m, s.min AS lo, s.max AS hi FROM (SELECT n_nationkey, RS_ZonalStatsAll({{f}}, z, 1) AS s FROM ({_BOXES}))")


@query(f"WITH {_BOX_ROWS} SELECT n_nationkey, {_ALL} FROM hit GROUP BY n_nationkey")
def zonal_bbox_relational(spark, sf_dir):
    zones = _on_grid(spark, sf_dir, f"SELECT n_nationkey, {{f}} AS path, z AS zone FROM ({_BOXES})")
    return relational.zonal_stats(zones, keys=["n_nationkey"]).selectExpr("n_nationkey", "count AS n", "sum AS s", f"{rounded('mean', 4)} AS m", "min AS lo", "max AS hi")


_CORNERS = [("1003.7 + n_nationkey * 20", "99903.7 - n_nationkey * 10"), ("1603.7 + n_nationkey * 10", "99903.7 - n_nationkey * 7"), ("1003.7 + n_nationkey * 15", "99403.7 + n_nationkey * 13")]
_WKT = "concat('POLYGON ((', {p0}, ', ', {p1}, ', ', {p2}, ', ', {p0}, '))')".format(**{f"p{i}": f"concat_ws(' ', CAST({x} AS DECIMAL(12,1)), CAST({y} AS DECIMAL(12,1)))" for i, (x, y) in enumerate(_CORNERS)})
_EDGES = "edge AS (" + " UNION ALL ".join(f"SELECT n_nationkey AS z, ({_CORNERS[i][0]})::DOUBLE AS x1, ({_CORNERS[i][1]})::DOUBLE AS y1, ({_CORNERS[j][0]})::DOUBLE AS x2, ({_CORNERS[j][1]})::DOUBLE AS y2 FROM nation" for i, j in ((0, 1), (1, 2), (2, 0))) + ")"
_CROSS = "sum(CASE WHEN (y2 > y) <> (y1 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1"
_POLYGON_ROWS = f"{PX}, {_EDGES}, inside AS (SELECT z, event_id, any_value(v1) AS v FROM edge, px WHERE v1 <> 0 GROUP BY z, event_id HAVING {_CROSS}), hit AS (SELECT n_nationkey, v FROM nation LEFT JOIN inside ON z = n_nationkey)"
_TRIANGLES = f"SELECT n_nationkey, {_WKT} AS z FROM nation"


@query(f"WITH {_POLYGON_ROWS} SELECT n_nationkey, {_ALL} FROM hit GROUP BY n_nationkey")
def zonal_polygon(spark, sf_dir):
    stat = lambda s: f"RS_ZonalStats({{f}}, z, 1, '{s}')"
    return _on_grid(spark, sf_dir, f"SELECT n_nationkey, CAST({stat('COUNT')} AS BIGINT) AS n, {stat('sum')} AS s, {rounded(stat('mean'), 4)} AS m, {stat('min')} AS lo, {stat('max')} AS hi FROM ({_TRIANGLES})")


@query(f"WITH {_POLYGON_ROWS} SELECT n_nationkey, {_ALL} FROM hit GROUP BY n_nationkey")
def zonal_relational(spark, sf_dir):
    zones = _on_grid(spark, sf_dir, f"SELECT n_nationkey, {{f}} AS path, z AS zone FROM ({_TRIANGLES})")
    return relational.zonal_stats(zones, keys=["n_nationkey"]).selectExpr("n_nationkey", "count AS n", "sum AS s", f"{rounded('mean', 4)} AS m", "min AS lo", "max AS hi")


@query(f"WITH {_POLYGON_ROWS} SELECT n_nationkey, count(v)::DOUBLE AS n FROM hit GROUP BY n_nationkey UNION ALL SELECT -1, NULL")
def zonal_batch(spark, sf_dir):
    zones = f"SELECT sort_array(collect_list(struct(n_nationkey, z))) AS zs FROM (SELECT -1 AS n_nationkey, CAST(NULL AS STRING) AS z UNION ALL {_TRIANGLES})"
    return _on_grid(spark, sf_dir, f"SELECT p.k AS n_nationkey, p.v AS n FROM (SELECT explode(arrays_zip(k, v)) AS p FROM (SELECT zs.n_nationkey AS k, RS_ZonalStatsBatch({{f}}, zs.z, 1, 'count') AS v FROM ({zones})))")


_HOLE = "MULTIPOLYGON (((1103.7 99803.7, 1503.7 99803.7, 1503.7 99993.7, 1103.7 99993.7, 1103.7 99803.7), (1203.7 99853.7, 1303.7 99853.7, 1303.7 99943.7, 1203.7 99943.7, 1203.7 99853.7)), ((1603.7 99903.7, 1703.7 99903.7, 1703.7 99983.7, 1603.7 99983.7, 1603.7 99903.7)))"
_IN_HOLE = "((x BETWEEN 1103.7 AND 1503.7 AND y BETWEEN 99803.7 AND 99993.7 AND NOT (x BETWEEN 1203.7 AND 1303.7 AND y BETWEEN 99853.7 AND 99943.7)) OR (x BETWEEN 1603.7 AND 1703.7 AND y BETWEEN 99903.7 AND 99983.7))"


@query(f"WITH {PX}, hit AS (SELECT v1 AS v FROM px WHERE v1 <> 0 AND {_IN_HOLE}) SELECT {_ALL} FROM hit")
def zonal_multipolygon_hole(spark, sf_dir):
    return _on_grid(spark, sf_dir, f"SELECT s.count AS n, s.sum AS s, {rounded('s.mean', 4)} AS m, s.min AS lo, s.max AS hi FROM (SELECT RS_ZonalStatsAll({{f}}, '{_HOLE}') AS s)")


@query("SELECT 0.0::DOUBLE AS n, CAST(NULL AS DOUBLE) AS m, 0.0::DOUBLE AS e, CAST(NULL AS DOUBLE) AS b")
def zonal_empty(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT RS_ZonalStats(f, array(0.0, 0.0, 1.0, 1.0), 1, 'count') AS n, RS_ZonalStats(f, array(0.0, 0.0, 1.0, 1.0), 1, 'mean') AS m, RS_ZonalStats(f, 'POLYGON EMPTY', 1, 'count') AS e, RS_ZonalStats(f, CAST(NULL AS STRING), 1, 'count') AS b FROM (SELECT {f} AS f)")


@query("SELECT 0.0::DOUBLE AS n, CAST(NULL AS DOUBLE) AS s")
def zonal_bad_band(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT RS_ZonalStats(f, z, 9, 'count') AS n, RS_ZonalStats(f, z, 9, 'sum') AS s FROM (SELECT {f} AS f, array(1000.0, 99900.0, 1100.0, 100000.0) AS z)")


def _array(spark, sf_dir, more: str, band: int = 1) -> DataFrame:
    return _on_grid(spark, sf_dir, f"SELECT CAST(pos AS BIGINT) AS pos, col AS v FROM (SELECT posexplode(RS_BandAsArray({{f}}, {band}{more})))")


@query(f"WITH {PX} SELECT event_id AS pos, nullif(v2, 0) AS v FROM px")
def band_as_array_full(spark, sf_dir):
    return _array(spark, sf_dir, "", 2)


@query(f"WITH {PX} SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, nullif(v1, 0) AS v FROM px WHERE x BETWEEN 1103.7 AND 1503.7 AND y BETWEEN 99913.7 AND 99993.7")
def band_as_array_bbox(spark, sf_dir):
    return _array(spark, sf_dir, ", array(1103.7, 99913.7, 1503.7, 99993.7)")


@query(f"WITH {PX} SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, CASE WHEN {_IN_HOLE} THEN nullif(v1, 0) END AS v FROM px WHERE x BETWEEN 1103.7 AND 1703.7 AND y BETWEEN 99803.7 AND 99993.7")
def band_as_array_wkt(spark, sf_dir):
    return _array(spark, sf_dir, f", '{_HOLE}'")


@query("SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)")
def embedding_chip_pixels(spark, sf_dir):
    eventgrid.embedding_chips(spark, sf_dir).createOrReplaceTempView("chips")
    return spark.sql("SELECT vec_id, CAST(pos AS BIGINT) AS pos, col AS v FROM (SELECT vec_id, posexplode(RS_BandAsArray(content, 1)) FROM chips)")


# ------------------------------------------------------------------ scenes
_SCENE_ROWS = f"{PX}, hit AS (SELECT event_type AS scene, n_nationkey, v1 AS v FROM nation JOIN px ON x BETWEEN 1003.7 + n_nationkey * 31 AND 1203.7 + n_nationkey * 37 AND y BETWEEN 99503.7 + n_nationkey * 11 AND 99903.7 + n_nationkey * 3 AND v1 <> 0)"


def _scene_zones(spark, sf_dir) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")
    zones = spark.sql(f"SELECT n_nationkey, z AS zone FROM ({_BOXES})")
    known = F.array(*(F.struct(F.lit(r.scene).alias("scene"), F.lit(r.path).alias("path")) for r in eventgrid.scenes(spark, sf_dir).collect()))  # five
    return zones.select("n_nationkey", "zone", F.explode(known).alias("s")).select("s.scene", "s.path", "n_nationkey", "zone")


@query(f"WITH {_SCENE_ROWS}, every AS (SELECT DISTINCT event_type AS scene, n_nationkey FROM px, nation) SELECT scene, n_nationkey, count(v) AS n, sum(v) AS s FROM every LEFT JOIN hit USING (scene, n_nationkey) GROUP BY scene, n_nationkey")
def scene_time_series(spark, sf_dir):
    return relational.zonal_stats(_scene_zones(spark, sf_dir), keys=["scene", "n_nationkey"]).selectExpr("scene", "n_nationkey", "count AS n", "sum AS s")


@query(f"WITH {_SCENE_ROWS}, t AS (SELECT scene, n_nationkey, sum(v) AS s FROM hit GROUP BY scene, n_nationkey) SELECT scene, n_nationkey, s, CAST(row_number() OVER (PARTITION BY scene ORDER BY s DESC, n_nationkey) AS INTEGER) AS place FROM t QUALIFY place <= 3")
def topk_zones(spark, sf_dir):
    stats = relational.zonal_stats(_scene_zones(spark, sf_dir), keys=["scene", "n_nationkey"]).where("sum IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("sum"), "n_nationkey"))
    return stats.withColumn("place", place).where("place <= 3").selectExpr("scene", "n_nationkey", "sum AS s", "place")


@query(f"WITH {PX} SELECT event_type AS scene, 100::INTEGER AS w, any_value(h)::INTEGER AS h, max(v1) AS hi FROM px, dim GROUP BY event_type")
def catalog_join_metadata(spark, sf_dir):
    eventgrid.scenes(spark, sf_dir).createOrReplaceTempView("scenes")
    return spark.sql("SELECT scene, RS_Width(path) AS w, RS_Height(path) AS h, RS_BandStats(path).max AS hi FROM scenes")


@query(f"WITH {PX}, hit AS (SELECT event_type AS scene, v1 AS v FROM px WHERE v1 <> 0 AND {_IN_HOLE}) SELECT scene, {_ALL} FROM hit GROUP BY scene")
def scene_stream(spark, sf_dir):
    scratch = Scratch(spark, "stream")
    folder = eventgrid.scenes(spark, sf_dir).first()["path"].rsplit("/", 1)[0]
    stats = streaming.zone_stats(streaming.arrivals(spark, folder), {"hole": _HOLE})
    streaming.run_available(stats, f"{scratch.path}/out", f"{scratch.path}/state")
    scene = F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("scene")
    return spark.read.parquet(f"{scratch.path}/out").where("count > 0").select(scene, F.col("count").alias("n"), F.col("sum").alias("s"), F.expr(rounded("mean", 4)).alias("m"), F.col("min").alias("lo"), F.col("max").alias("hi"))


@query(f"WITH {PX}, s AS (SELECT DISTINCT event_type AS scene FROM events) SELECT scene, CAST(4 * ceil(h / 32.0) AS BIGINT) AS n, 2000.0::DOUBLE AS right_edge, 100000.0 - h * 10.0::DOUBLE AS bottom FROM s, dim")
def read_cog_lateral(spark, sf_dir):
    eventgrid.scenes(spark, sf_dir).createOrReplaceTempView("scenes")
    return spark.sql("SELECT scene, count(*) AS n, max(t.bbox.xmax) AS right_edge, min(t.bbox.ymin) AS bottom FROM scenes, LATERAL read_cog(scenes.path) AS t WHERE t.level = 0 GROUP BY scene")


@query(f"WITH {PX}, hit AS (SELECT event_type AS scene, v1 AS v FROM px WHERE v1 <> 0 AND {_IN_HOLE}), every AS (SELECT DISTINCT event_type AS scene FROM events) SELECT scene, 100::INTEGER AS w, h::INTEGER AS h, count(v) AS n, sum(v) AS s FROM dim, every LEFT JOIN hit USING (scene) GROUP BY scene, h")
def rs_on_content(spark, sf_dir):
    """Files as binary content, metadata and zones without a path."""
    folder = eventgrid.scenes(spark, sf_dir).first()["path"].rsplit("/", 1)[0]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder)
    found = files.select(F.regexp_extract("path", r"([^/]+)\.tif$", 1).alias("scene"), F.expr("RS_MetaData(content)").alias("m"), F.expr(f"RS_ZonalStatsAll(content, '{_HOLE}')").alias("s"))
    return found.select("scene", F.col("m.width").alias("w"), F.col("m.height").alias("h"), F.col("s.count").alias("n"), F.col("s.sum").alias("s"))


# ------------------------------------------------------------------ catalogues
_ITEMS = "item AS (SELECT p_partkey, p_size, p_retailprice, p_size % 3 <> 0 AS known, p_brand, unnest(CASE WHEN p_size % 2 = 1 THEN ['data', 'preview'] ELSE ['data'] END) AS asset_key FROM part)"


@query(
    f"WITH {_ITEMS} SELECT 'part-' || p_partkey AS item_id, CASE WHEN known THEN p_brand END AS collection, '2026-01-01T00:00:00Z' AS datetime, asset_key, 'part/' || p_partkey || CASE asset_key WHEN 'data' THEN '.tif' ELSE '.png' END AS href, "
    "CASE asset_key WHEN 'data' THEN 'image/tiff' END AS media_type, CASE WHEN known THEN p_size::DOUBLE END AS xmin, CASE WHEN known THEN p_size + 1.0::DOUBLE END AS xmax, CASE WHEN known THEN 1.0::DOUBLE END AS ymax FROM item"
)
def stac_items(spark, sf_dir):
    paths = eventgrid.part_catalogue(spark, sf_dir)
    rows = " UNION ALL ".join(f"SELECT * FROM read_stac('{p}')" for p in paths)
    return spark.sql(f"SELECT item_id, collection, datetime, asset_key, href, media_type, bbox.xmin AS xmin, bbox.xmax AS xmax, bbox.ymax AS ymax FROM ({rows})")


@query(f"WITH {_ITEMS} SELECT 'part-' || p_partkey AS item_id, 0.0::DOUBLE AS lo, p_retailprice AS hi, p_size::DOUBLE AS mean, true AS no_sd, 2::INTEGER AS bands FROM item WHERE asset_key = 'data'")
def stac_band_stats(spark, sf_dir):
    rows = spark.read.format("stac").option("paths", json.dumps(eventgrid.part_catalogue(spark, sf_dir))).load().where("band_stats IS NOT NULL")
    return rows.selectExpr("item_id", "band_stats[0].min AS lo", "band_stats[0].max AS hi", "band_stats[0].mean AS mean", "band_stats[0].stddev IS NULL AND band_stats[1].max IS NULL AS no_sd", "size(band_stats) AS bands")


def _search(spark, arguments: str) -> DataFrame:
    url = loopback.address(loopback.search_server(120, 50, loopback.driver_host(spark)), "/search")
    return spark.sql(f"SELECT item_id, collection, asset_key, href FROM read_stac_search('{url}'{arguments})")


@query("SELECT 'scene-' || i AS item_id, 'c1' AS collection, 'B04' AS asset_key, 'scene-' || i || '.tif' AS href FROM generate_series(0, 119) AS t(i)")
def stac_search_paged(spark, sf_dir):
    return _search(spark, ", collections => array('c1')")


@query("SELECT 'scene-' || i AS item_id, 'all' AS collection, 'B04' AS asset_key, 'scene-' || i || '.tif' AS href FROM generate_series(0, 69) AS t(i)")
def stac_search_cap(spark, sf_dir):
    return _search(spark, ", max_rows => 70, page_size => 30")


# ------------------------------------------------------------------ service tables
@query(f"SELECT '{rasterspark.__version__}' AS version")
def cog_version(spark, sf_dir):
    return spark.sql("SELECT * FROM cog_version()")


def _probe(spark, sf_dir) -> DataFrame:
    """Changes of one worker's cache counters by reading every tile of a remote raster twice."""
    server = loopback.file_server(eventgrid.short_grid(spark, sf_dir), loopback.driver_host(spark))
    url = loopback.address(server, f"/file?{uuid.uuid4().hex}")  # an address that no worker has opened before

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                before = cache.tiles.stats()
                for _ in range(2):
                    raster = engine.open_raster(path)
                    for _ in raster.tiles([(x, y) for y in range(raster.top.tiles_y) for x in range(raster.top.tiles_x)]):
                        pass
                after = cache.tiles.stats()
                yield pa.RecordBatch.from_pylist([{k: after[k] - before[k] for k in ("misses", "hits", "bytes")}], schema=pa.schema([(k, pa.int64()) for k in ("misses", "hits", "bytes")]))

    return spark.createDataFrame([(url,)], "path string").mapInArrow(probe, "misses bigint, hits bigint, bytes bigint")


@query(f"WITH {PX} SELECT CAST(4 * ceil(h / 32.0) AS BIGINT) AS misses, CAST(4 * ceil(h / 32.0) AS BIGINT) AS hits, CAST(4 * ceil(h / 32.0) * 32 * 32 * 2 * 2 AS BIGINT) AS bytes FROM dim")
def cog_cache_hits(spark, sf_dir):
    """Each tile is fetched once and found once."""
    return _probe(spark, sf_dir)


@query("SELECT CAST(0 AS BIGINT) AS misses, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS bytes")
def cog_cache_off(spark, sf_dir):
    """With the tile cache turned off nothing is counted or kept."""
    old = tables.configure_caches(spark, tile_mb=0)
    try:
        rows = _probe(spark, sf_dir).collect()
    finally:
        tables.restore_caches(spark, old)
    return spark.createDataFrame(rows, "misses bigint, hits bigint, bytes bigint")


@query("SELECT true AS ok")
def cog_cache_stats(spark, sf_dir):
    return spark.sql("SELECT hits >= 0 AND misses >= 0 AND evictions >= 0 AND bytes BETWEEN 0 AND max_bytes AS ok FROM cog_cache_stats()")


@query(f"WITH {PX}, hit AS (SELECT sum(v1) AS s FROM px, dim WHERE v1 <> 0 AND x BETWEEN 1250 AND 1750 AND y BETWEEN 100000 - h * 7.5 AND 100000 - h * 2.5) SELECT 12::BIGINT AS metrics, s AS checksum, 1.0::DOUBLE AS opens FROM hit")
def cog_io_bench(spark, sf_dir):
    return _on_grid(spark, sf_dir, "SELECT count(*) AS metrics, max(value) FILTER (WHERE metric = 'window_checksum') AS checksum, max(value) FILTER (WHERE metric = 'meta_fetches') AS opens FROM cog_io_bench({f}, io => 'file')")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zonal statistics of a polygon for each nation over the event grid, as a partial and final plan."""
    return QUERIES["zonal_relational"](spark, sf_dir)
