"""Catalogue documents, searches, relational plans and streams."""

import json

import numpy as np
import pytest

from rasterspark import hostqueries
from rasterspark.functions.register import register
from rasterspark.loopback import search_server
from rasterspark.operators import joins, relational
from rasterspark.queries import QUERIES
from rasterspark.sources import stac
from rasterspark.streaming import scenes
from tests.fixtures import SCENES, in_window, in_zone, make, zone


def item(name="a", **more):
    return {"type": "Feature", "id": name, "properties": {}, "assets": {"z": {"href": "z.tif"}, "a": {"href": "a.tif", "type": "t"}, "none": {}}, **more}


def test_documents():
    rows = stac.document_rows(json.dumps({"type": "FeatureCollection", "features": [item(bbox=[1, 2, 3, 4, 5, 6], collection="c", properties={"datetime": "d"}), item("b", bbox=[1, 2])]}).encode())
    assert [r[:6] for r in rows] == [("a", "c", "d", "a", "a.tif", "t"), ("a", "c", "d", "z", "z.tif", None), ("b", None, None, "a", "a.tif", "t"), ("b", None, None, "z", "z.tif", None)]
    assert rows[0][6] == (1, 2, 4, 5) and rows[2][6] is None
    bands = item(assets={"x": {"href": "x", "raster:bands": [{"statistics": {"minimum": 1, "mean": "no"}}, {}]}})
    assert stac.document_rows(json.dumps(bands).encode())[0][7] == [(1, None, None, None), (None,) * 4]


@pytest.mark.parametrize("text", ["not json", '{"type": "Catalog"}', '{"type": "Feature"}', '{"type": "Feature", "id": 5}', '{"type": "FeatureCollection"}', "[]"])
def test_bad_documents(text, tmp_path):
    path = tmp_path / "invalid.json"
    path.write_text(text)
    with pytest.raises(stac.CatalogueError, match="invalid.json"):
        stac.read_document(str(path))


def test_next_links():
    body = {"collections": ["c"], "limit": 5}
    assert stac.following(body, {"href": "u", "method": "POST", "merge": True, "body": {"limit": 6, "token": 1}}) == ("u", "POST", {"collections": ["c"], "limit": 6, "token": 1})
    assert stac.following(body, {"href": "u", "body": {"token": 1}}) == ("u", "GET", {"token": 1})
    assert stac.following(body, {"href": "u"}) == ("u", "GET", None)
    assert stac.search_body(bbox=[1, 2, 3, 4], limit=0) == {"bbox": [1, 2, 3, 4], "limit": 0}


def test_search_caps():
    url = lambda n, page: f"http://127.0.0.1:{search_server(n, page).server_port}/search"
    assert len(list(stac.search(url(1000, 600)))) == 1000
    with pytest.raises(stac.CatalogueError, match="row cap"):
        next(stac.search(url(1200, 600)))
    assert len(list(stac.search(url(1200, 600), max_rows=50))) == 50 and len(list(stac.search(url(1200, 600), max_rows=5000))) == 1200
    assert list(stac.search(url(5, 2), collections=["empty"])) == []
    for bad in ({"max_rows": 0}, {"page_size": -1}, {"bbox": [1, 2]}):
        with pytest.raises(stac.CatalogueError, match="read_stac_search"):
            list(stac.search("http://127.0.0.1:1/search", **bad))
    with pytest.raises(stac.CatalogueError, match="read_stac_search"):
        list(stac.search("http://127.0.0.1:1/search"))


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return make(tmp_path_factory.mktemp("rasters"))


def test_relational_zones_equal_the_functions(spark, paths):
    register(spark)
    hills, strip = SCENES["hills"], SCENES["strip"]
    rows = [(i, paths["hills"], z) for i, z in enumerate([zone("ell"), zone("pair"), zone("sliver"), "POLYGON EMPTY", "POLYGON ((0 0, 1 0, 1 1, 0 0))", None])] + [(9, None, zone("ell")), (10, paths["strip"], strip.wkt([[(20, 10), (300, 15), (310, 90), (60, 80)]]))]
    zones = spark.createDataFrame(rows, "k int, path string, zone string")
    for salt in (1, 4):
        got = {r.k: tuple(r)[1:] for r in relational.zonal_stats(zones, keys=["k"], salt=salt).collect()}
        want = {r.k: None if r.s is None else tuple(r.s) for r in zones.selectExpr("k", "RS_ZonalStatsAll(path, zone) AS s").collect()}
        assert {k: None if v[0] is None else v for k, v in got.items()} == want
    boxes = spark.createDataFrame([(1, paths["hills"], [float(v) for v in hills.box(100, 100, 199, 149)]), (2, paths["hills"], [0.0, 0.0, 1.0, 1.0]), (3, paths["hills"], [0.0, None, 1.0, 1.0])], "k int, path string, zone array<double>")
    got = {r.k: (r["count"], r["sum"]) for r in relational.zonal_stats(boxes, keys=["k"]).collect()}
    assert got == {1: (5000, sum(in_window("hills", 100, 100, 199, 149))), 2: (0, None), 3: (None, None)}
    with pytest.raises(Exception, match="bbox"):
        relational.zonal_stats(boxes.selectExpr("k", "path", "array(2D, 0D, 1D, 1D) AS zone"), keys=["k"]).collect()
    assert relational.zonal_stats(zones.limit(0), keys=["k"]).collect() == []
    assert {r["count"] for r in relational.zonal_stats(boxes, keys=["k"], band=7).collect()} == {0, None}


def test_relational_points_keep_all_rows(spark, paths):
    register(spark)
    rng = np.random.default_rng(0)
    spot = lambda s: (float(s.left + (rng.random() * 1.1 - 0.05) * s.width * s.pixel), float(s.top - (rng.random() * 1.1 - 0.05) * s.height * s.pixel))
    rows = [(i, paths[n], *spot(SCENES[n])) for i in range(300) for n in ["hills" if i % 3 else "strip"]] + [(500, None, 1.0, 1.0), (501, paths["hills"], None, 1.0)]
    points = spark.createDataFrame(rows, "id int, path string, x double, y double")
    got = {r.id: r.value for r in relational.sample_points(points).collect()}
    assert got == {r.id: r.value for r in points.selectExpr("id", "RS_Value(path, x, y) AS value").collect()} and len(got) == 302
    assert any(v is not None for v in got.values())
    nd = {r.id: r.nd for r in relational.normalized_difference(points, 1, 1).collect()}
    assert all((nd[k] is None) == (v is None) for k, v in got.items())


def test_stream_of_scenes(spark, tmp_path):
    register(spark)
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    stats = lambda: scenes.zone_stats(scenes.arrivals(spark, str(folder)), {"ell": zone("ell"), "sliver": zone("sliver")})
    made = make(folder)
    scenes.run_available(stats(), out, state)
    first = spark.read.parquet(out)
    assert first.count() == 2 * len(made)
    assert {(r.zone_id, r["count"]) for r in first.where("path LIKE '%hills%'").collect()} == {(z, len(in_zone("hills", z))) for z in ("ell", "sliver")}
    (folder / "late.tif").write_bytes((folder / "hills.tif").read_bytes())
    scenes.run_available(stats(), out, state)
    assert spark.read.parquet(out).count() == 2 * len(made) + 2
    series = scenes.windowed(stats(), time="arrived", size="365 days")
    query = series.writeStream.format("memory").queryName("series").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    totals = {r.zone_id: r.pixels for r in spark.sql("SELECT zone_id, sum(pixels) AS pixels FROM series GROUP BY zone_id").collect()}
    counted = {z: first.where(f"zone_id = '{z}'").agg({"count": "sum"}).first()[0] + len(in_zone("hills", z)) for z in ("ell", "sliver")}
    assert totals == counted


def test_registered_queries_equal_their_sql(spark):
    import os

    import duckdb

    import __spark_entry__ as entry

    sf, oracle = "/root/testdata/sf0.001", entry.oracle_sql()
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    for name, run in (QUERIES | hostqueries.QUERIES).items():
        rows = run(spark, sf)
        answer = db.execute(oracle[name])
        columns = [c[0] for c in answer.description]
        assert sorted(rows.columns) == sorted(columns), name
        want = sorted((tuple(r) for r in answer.fetchall()), key=repr)
        assert sorted((tuple(r) for r in rows.select(*columns).collect()), key=repr) == want, name
    assert entry.entry(spark).count() == 25
