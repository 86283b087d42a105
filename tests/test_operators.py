"""Ordered joins, plans without shuffles of hot paths, shared reads of remote files, and the driver's entry."""

import os
import shutil
import subprocess
import sys
import threading
import time
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pytest

from rasterspark import loopback, session
from rasterspark.functions import cache, engine
from rasterspark.functions.register import register
from rasterspark.operators import joins, relational
from rasterspark.sources import datasource
from tests.fixtures import SCENES, make, tiles_of, zone

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return make(tmp_path_factory.mktemp("rasters"))


# ------------------------------------------------------------------ ordered joins
@pytest.mark.parametrize("width", [3.0, 40.0, 1000.0])
def test_as_of_join_equals_a_plain_scan(spark, width):
    rng = np.random.default_rng(1)
    left = [(i, "hot" if i % 3 else f"k{i % 7}", float(rng.integers(-50, 200))) for i in range(240)] + [(900, None, 5.0), (901, "hot", None), (902, "never", 5.0)]
    right = [("hot" if i % 2 else f"k{i % 7}", float(rng.integers(-20, 180)), i, f"v{i}") for i in range(120)] + [(None, 0.0, 500, "x"), ("hot", None, 501, "y"), ("k1", 3.0, 502, "p"), ("k1", 3.0, 503, "q")]
    a = spark.createDataFrame(left, "id int, k string, t double")
    b = spark.createDataFrame(right, "k string, t double, v int, w string")
    got = {r.id: (r.v, r.w) for r in joins.as_of_join(a, b, by=["k"], at="t", take=["v", "w"], width=width).collect()}
    want = {}
    for i, k, t in left:
        known = [(u, v, w) for q, u, v, w in right if q == k and k is not None and t is not None and u is not None and u <= t]
        want[i] = max(known)[1:] if known else (None, None)
    assert got == want
    assert joins.as_of_join(a.limit(0), b, by=["k"], at="t", take=["v"], width=width).collect() == []
    assert {r.v for r in joins.as_of_join(a, b.limit(0), by=["k"], at="t", take=["v"], width=width).collect()} == {None}


@pytest.mark.parametrize("width", [1.0, 7.0, 500.0])
def test_interval_join_equals_all_pairs(spark, width):
    rng = np.random.default_rng(2)
    points = [(i, float(rng.integers(-40, 60)) / 2) for i in range(90)] + [(900, None)]
    spans = [(i, float(a), float(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-30, 30, 40), rng.integers(-2, 25, 40), strict=True))] + [(800, None, 4.0), (801, 0.0, None)]
    got = joins.interval_join(spark.createDataFrame(points, "p int, at double"), spark.createDataFrame(spans, "s int, lo double, hi double"), at="at", low="lo", high="hi", width=width)
    want = [(p, s) for p, t in points for s, a, b in spans if None not in (t, a, b) and a <= t <= b]
    assert sorted((r.p, r.s) for r in got.collect()) == sorted(want)


def test_times_join_by_seconds(spark):
    a = spark.sql("SELECT 1 AS k, TIMESTAMP '2026-01-01 10:00:00' AS t UNION ALL SELECT 1, TIMESTAMP '2026-01-03 00:00:00'")
    b = spark.sql("SELECT 1 AS k, TIMESTAMP '2026-01-01 09:59:59' AS t, 'early' AS v UNION ALL SELECT 1, TIMESTAMP '2026-01-01 10:00:01', 'late'")
    assert [r.v for r in joins.as_of_join(a, b, by=["k"], at="t", take=["v"], width=3600).orderBy("t").collect()] == ["early", "late"]


# ------------------------------------------------------------------ raster plans
def points_of(spark, paths, n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        name = "strip" if i % 10 == 0 else "hills"
        s = SCENES[name]
        rows.append((i, paths[name], s.left + (rng.random() * 1.2 - 0.1) * s.width * s.pixel, s.top - (rng.random() * 1.2 - 0.1) * s.height * s.pixel, int(rng.integers(-5, 700)), int(rng.integers(-5, 700))))
    rows += [(1000, None, 1.0, 1.0, 1, 1), (1001, paths["hills"], None, 1.0, None, 1), (1002, paths["hills"], 1e30, 1.0, 1, 1), (1003, paths["hills"], float("nan"), 1.0, 1, 1)]
    return spark.createDataFrame(rows, "id int, path string, x double, y double, c int, r int")


@pytest.mark.parametrize("broadcast", [0, 100])
def test_coordinates_by_columns_equal_the_functions(spark, paths, monkeypatch, broadcast):
    register(spark)
    monkeypatch.setattr(relational, "BROADCAST_PATHS", broadcast)
    points = points_of(spark, paths)
    got = {r.id: None if r.col is None or r.row is None else (r.col, r.row) for r in relational.world_to_raster(points).collect()}
    want = {r.id: r.w and (r.w.col, r.w.row) for r in points.selectExpr("id", "RS_WorldToRasterCoord(path, x, y) AS w").collect()}
    assert got == want and sum(v is not None for v in got.values()) == 400
    got = {r.id: None if r.x is None else (r.x, r.y) for r in relational.raster_to_world(points, col="c", row="r").collect()}
    want = {r.id: r.w and (r.w.x, r.w.y) for r in points.selectExpr("id", "RS_RasterToWorldCoord(path, c, r) AS w").collect()}
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_hot_path_are_not_shuffled_for_its_metadata(spark, paths):
    plan = plan_of(relational.world_to_raster(points_of(spark, paths)))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_two_bands_are_one_pass(spark, paths):
    plan = plan_of(relational.normalized_difference(points_of(spark, paths), 1, 1))
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_bands_of_one_pass_equal_the_functions(spark, paths):
    register(spark)
    s = SCENES["trio"]
    rows = [(i, paths["trio"], float(s.x(i % 60 - 5)), float(s.y(i % 47 - 3))) for i in range(300)]
    points = spark.createDataFrame(rows, "id int, path string, x double, y double")
    got = {r.id: (r.a, r.b, r.z) for r in relational.sample_bands(points, {"a": 1, "b": 3, "z": 9}).collect()}
    want = {r.id: (r.a, r.b, None) for r in points.selectExpr("id", "RS_Value(path, x, y) AS a", "RS_Value(path, x, y, 3) AS b").collect()}
    assert got == want
    nd = {r.id: r.nd for r in relational.normalized_difference(points, 1, 2).collect()}
    assert nd == {r.id: r.nd for r in points.selectExpr("id", "RS_NormalizedDifference(path, x, y, 1, 2) AS nd").collect()}


def test_many_files_are_opened_by_their_tasks(spark, paths, monkeypatch):
    register(spark)
    names = ["hills", "strip", "trio", "holes"]
    reader = datasource.CogReader([paths[n] for n in names])
    monkeypatch.setattr(datasource.engine, "Opener", lambda: pytest.fail("opened while planning"))
    assert len(reader.partitions()) == 4
    monkeypatch.undo()
    import json

    rows = spark.read.format("cog").option("paths", json.dumps([paths[n] for n in names])).load()
    assert {r.path: r["count"] for r in rows.groupBy("path").count().collect()} == {paths[n]: tiles_of(n) for n in names}
    assert rows.where("level = 0").count() == sum(-(-SCENES[n].width // SCENES[n].tile) * -(-SCENES[n].height // SCENES[n].tile) for n in names)
    monkeypatch.setattr(datasource, "SLOTS", 2)
    assert [len(p.paths) for p in datasource.CogReader([paths[n] for n in names]).partitions()] == [2, 2]


# ------------------------------------------------------------------ remote files
def test_rasters_of_a_batch_are_read_at_the_same_time(paths, monkeypatch):
    import pyarrow as pa

    from rasterspark.functions import register as functions

    monkeypatch.setattr(cache, "rasters", cache.OpenCache(0))
    busy, most, lock = [0], [0], threading.Lock()
    own = engine.Raster._fetch

    def slow(self, wanted):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.05)
        try:
            return own(self, wanted)
        finally:
            with lock:
                busy[0] -= 1

    monkeypatch.setattr(engine.Raster, "_fetch", slow)
    servers = [loopback.file_server(paths[n]) for n in ("hills", "deflated", "zstandard", "lempel")]
    urls = [loopback.address(s, f"/file?{k}") for k, s in enumerate(servers)]
    s = SCENES["hills"]
    box = [float(v) for v in s.box(1, 1, 5, 5)]
    local = [paths[n] for n in ("hills", "deflated", "zstandard", "lempel")]
    got = functions._zonal(pa.array(urls * 2), pa.array([box] * 8), pa.array([1] * 8), pa.array(["sum"] * 8)).to_pylist()
    assert most[0] > 1
    assert got == functions._zonal(pa.array(local * 2), pa.array([box] * 8), pa.array([1] * 8), pa.array(["sum"] * 8)).to_pylist()
    most[0] = 0
    value = lambda p: functions._value(pa.array(p), pa.array([s.x(3)] * 4), pa.array([s.y(7)] * 4)).to_pylist()
    assert value(urls) == value(local) and most[0] > 1


def test_a_tile_that_many_threads_want_is_fetched_once(paths, monkeypatch):
    monkeypatch.setattr(cache, "tiles", cache.TileCache(10_000_000))
    monkeypatch.setattr(cache, "rasters", cache.OpenCache(60))
    fetched = []
    own = engine.Raster._fetch

    def slow(self, wanted):
        fetched.extend(wanted)
        time.sleep(0.05)
        return own(self, wanted)

    monkeypatch.setattr(engine.Raster, "_fetch", slow)
    raster = engine.open_raster(loopback.address(loopback.file_server(paths["hills"]), "/file"))
    want = [(0, 0), (1, 0), (2, 1)]
    out = [None] * 8

    def read(k):
        out[k] = {t: tile.sum() for t, tile in raster.tiles(want)}

    threads = [threading.Thread(target=read, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(fetched) == sorted(want) and all(o == out[0] and len(o) == 3 for o in out)
    assert not cache.tiles.coming


def test_waiting_threads_go_on_when_the_first_one_fails():
    held = cache.TileCache(1000)
    assert held.claim(("a",)) == (None, True) and held.claim(("a",)) == (None, False)
    found = []
    waiting = threading.Thread(target=lambda: found.append(held.wait(("a",))))
    waiting.start()
    held.settle(("a",), None)
    waiting.join(5)
    assert found == [None] and held.claim(("a",)) == (None, True)


def test_caches_are_configured_for_new_workers(spark):
    from rasterspark.functions import tables

    env = spark.sparkContext.environment
    before = dict(env)
    old = tables.configure_caches(spark, tile_mb=3, ttl_s=0)
    assert {r.max_bytes for r in tables.cache_stats(spark, 2).collect()} == {3_000_000}
    tables.restore_caches(spark, old)
    assert dict(env) == before and {r.max_bytes for r in tables.cache_stats(spark, 2).collect()} == {256_000_000}
    with pytest.raises(ValueError):
        tables.configure_caches(spark, tile_mb=-1)


# ------------------------------------------------------------------ session and entry
def test_a_cluster_needs_a_shared_folder(tmp_path):
    def fake(master, folder=None):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: folder), getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
        return SimpleNamespace(sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs://store/shared/")) == "hdfs://store/shared"
    assert Path(session.shared_dir(fake("local[4]"))).is_dir()


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    texts = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 20000) AS text")
    got = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 4000 and max(r.bytes for r in got) < 20 << 20


def test_scratch_folders_of_a_block_are_removed(spark):
    outer = session.Scratch(spark, "outer")
    with session.released():
        inner = session.Scratch(spark, "inner")
        kept = outer.table(inner.table(spark.range(5), "a"), "b")
        assert Path(inner.path.removeprefix("file:")).is_dir()
    assert not Path(inner.path.removeprefix("file:")).exists() and kept.count() == 5


def test_the_entry_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(q) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    (copy / "rasterspark" / "llm").mkdir()
    (copy / "rasterspark" / "llm" / "__init__.py").write_text("")
    (copy / "rasterspark" / "llm" / "queries.py").write_text("import no_such_module")
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    (copy / "corpus_pipeline.py").write_text("")
    assert subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True).returncode  # a broken part is an error


def test_the_pipeline_of_another_copy_does_not_count(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; assert e.corpus_pipeline is None and e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(ROOT)}, check=True)


def test_zones_over_many_files(spark, paths):
    register(spark)
    rows = [(k, paths["hills"], zone("pair")) for k in range(3)]
    got = relational.zonal_stats(spark.createDataFrame(rows, "k int, path string, zone string"), keys=["k"]).collect()
    assert len({tuple(r)[1:] for r in got}) == 1 and len(got) == 3
