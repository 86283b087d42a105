"""Reader, model, zones, caches and fetch counts, without Spark."""

import http.server
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterspark.functions import cache, engine
from rasterspark.functions.bench import scattered, workload
from rasterspark.functions.model import RasterError, band_statistics, pack_key, unpack_key
from rasterspark.functions.zone import ZoneError, parse
from rasterspark.sources import tiff
from rasterspark.sources.bytesource import BytesSource, CountingSource, HttpSource, LocalSource, open_source
from rasterspark.sources.cogwrite import lzw, write_cog
from tests.fixtures import SCENES, in_zone, make, pixels, zone


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    return make(tmp_path_factory.mktemp("rasters"))


def raster(data, **options):
    return engine.Raster(BytesSource(write_cog(data, **options)))


KINDS = ["u1", "u2", "u4", "u8", "i1", "i2", "i4", "i8", "f4", "f8", "bool"]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("planar", [False, True])
@pytest.mark.parametrize("compression", ["none", "deflate", "zstd", "lzw"])
def test_every_layout_decodes(order, big, planar, compression):
    rng = np.random.default_rng(1)
    for kind in KINDS:
        data = (rng.random((3, 37, 41)) * 200 - (100 if kind[0] in "if" else 0)).astype(kind)
        for predictor in (1, 2, 3):
            if (predictor == 2 and (kind == "bool" or kind[0] == "f")) or (predictor == 3 and kind[0] != "f"):
                continue
            r = raster(data, tile=16, order=order, big=big, planar=planar, compression=compression, predictor=predictor)
            got = np.stack([r.band_array(b + 1)[0].reshape(37, 41) for b in range(3)])
            assert np.array_equal(got, data.astype(float)), (kind, predictor)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=9000))
def test_lzw_round_trip(data):
    assert tiff.unlzw(lzw(data)) == data


def test_lzw_widths():
    data = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.unlzw(lzw(data)) == data


def test_packbits():
    assert tiff.unpackbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == b"\1\2\3\x09\x09\x09\7"


def test_nan_nodata_missing_georeference_and_sparse_tiles():
    data = np.array([[[1.0, np.nan], [2.0, 4.0]]], np.float32)
    r = raster(data, tile=16, origin=(0, 20), nodata=" NaN ")
    (s,) = r.zonal([[0, 0, 20, 20]], 1)
    assert (s.count, s.sum, s.min, s.max) == (3, 7, 1, 4)
    plain = raster(data, tile=16, origin=(0, 20))
    (s,) = plain.zonal([[0, 0, 20, 20]], 1)
    assert s.count == 4 and np.isnan(s.sum) and (s.min, s.max) == (1, 4)
    lost = raster(data, tile=16, origin=None)
    assert lost.meta.crs is None and lost.meta.srid == 0 and lost.meta.georeference_text() is None
    assert len(lost.band_array(1)[0]) == 4 and [t[6] for t in lost.meta.tiles()] == [None]
    for call in (lambda: lost.pixels([0], [0], 1), lambda: lost.zonal([[0, 0, 1, 1]], 1), lambda: list(lost.meta.tiles([0, 0, 1, 1])), lambda: lost.meta.world_to_grid(0, 0)):
        with pytest.raises(RasterError, match="georeference"):
            call()
    sparse = raster(np.pad(np.ones((1, 16, 16), np.uint8), ((0, 0), (0, 0), (0, 16))), tile=16, sparse=True, nodata="0")
    values, known = sparse.band_array(1)
    assert known.sum() == 256 and values[known].sum() == 256
    assert raster(data, tile=16, epsg=None).meta.srid == 0 and raster(data, tile=16, epsg=4326, geographic=True).meta.crs == "EPSG:4326"


def test_strips_and_other_files_are_errors():
    with pytest.raises(tiff.TiffError, match="not a TIFF"):
        engine.Raster(BytesSource(b"PNG is not it"))
    data = write_cog(np.zeros((1, 4, 4), np.uint8), tile=16)
    with pytest.raises(tiff.TiffError, match="not tiled"):
        engine.Raster(BytesSource(data.replace(b"\x42\x01\x04\x00", b"\x43\x81\x04\x00")))
    with pytest.raises((tiff.TiffError, EOFError)):
        engine.Raster(BytesSource(data[:60]))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 255), st.integers(0, 2**24 - 1), st.integers(0, 2**24 - 1))
def test_keys_round_trip(level, x, y):
    assert unpack_key(pack_key(level, x, y)) == (level, x, y)
    assert pack_key(level, x + 2**24, y) is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(299000, 306000), min_size=2, max_size=2), st.lists(st.floats(3994000, 4001000), min_size=2, max_size=2))
def test_pruned_tiles_equal_filtered_tiles(xs, ys):
    r = raster(np.zeros((1, 300, 400), np.uint8), tile=64, overviews=(2, 4), origin=(300000, 4000000))
    box = [min(xs), min(ys), max(xs), max(ys)]
    want = [t for t in r.meta.tiles() if t[6][0] <= box[2] and t[6][2] >= box[0] and t[6][1] <= box[3] and t[6][3] >= box[1]]
    assert list(r.meta.tiles(box)) == want


@settings(max_examples=100, deadline=None)
@given(st.integers(-50, 500), st.integers(-50, 500))
def test_coordinates_round_trip(col, row):
    r = raster(np.zeros((1, 8, 8), np.uint8), tile=16, origin=(300000, 4000000))
    assert r.meta.world_to_grid(*r.meta.grid_to_world(col, row)) == (col, row)


@pytest.mark.parametrize("name", ["ell", "pair", "sliver"])
def test_polygons(paths, name):
    (s,) = engine.open_raster(paths["hills"]).zonal([parse(zone(name))], 1)
    want = in_zone("hills", name)
    assert (s.count, s.sum, s.min, s.max) == (len(want), sum(want), min(want), max(want))


def plain_contains(zone, x, y):
    inside = False
    for x1, y1, x2, y2 in zone.edges():
        if (y2 > y) != (y1 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.floats(-3, 13), st.floats(-3, 13)), min_size=3, max_size=7), min_size=1, max_size=3))
def test_mask_equals_ray_casting(rings):
    text = "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + ")" for r in rings) + ")"
    zone, xs, ys = parse(text), np.arange(10) + 0.5, np.arange(10)[::-1] + 0.5
    assert zone.mask(xs, ys).tolist() == [[plain_contains(zone, x, y) for x in xs] for y in ys]


@pytest.mark.parametrize("text", ["", "POLYGON", "POLYGON (", "POLYGON ((1 2, 3))", "POLYGON ((1 2, 3 4)) x", "CIRCLE (1 2)", "POLYGON ((1 2 3 4 5, 1 1))", "POLYGON ((1e999 2, 3 4))", "POINT (1 2)", "geometrycollection empty"])
def test_bad_zones(text):
    with pytest.raises(ZoneError, match="zone"):
        parse(text)


def test_good_zones():
    assert parse(" polygon z ((0 0 1, 1 0 1, 1 1 1, 0 0 1)) ").envelope() == [0, 0, 1, 1]
    assert parse("POLYGON EMPTY").envelope() is None and parse("MULTIPOLYGON EMPTY").envelope() is None
    assert parse("MULTIPOLYGON (((0 0, 2 0, 0 2)), EMPTY)").envelope() == [0, 0, 2, 2]


def test_statistics_text():
    text = '<Item name="STATISTICS_MEAN" sample="1">2.5</Item><Item name="STATISTICS_MAXIMUM">7</Item><Item name="STATISTICS_MINIMUM" sample="5">1</Item><Item name="STATISTICS_STDDEV">x</Item>'
    first, second = band_statistics(text, 2)
    assert (first.max, first.mean, first.stddev) == (7, None, None) and second.mean == 2.5
    assert band_statistics('<Item name="STATISTICS_VALID_PERCENT">100</Item>', 1) is None and band_statistics("", 1) is None


# ------------------------------------------------------------------ fetch counts
def counted(path):
    source = CountingSource(LocalSource(path))
    return source, engine.Raster(source)


def test_opening_is_one_fetch_and_listing_none(paths):
    for path in paths.values():
        source, r = counted(path)
        assert source.fetches == 1
        assert list(r.meta.tiles()) and source.fetches == 1
    source, _ = counted(paths["hills"])
    assert source.bytes * 4 < LocalSource(paths["hills"]).size


def test_tiles_of_a_batch_are_read_once(paths):
    source, r = counted(paths["hills"])
    s, tile = SCENES["hills"], 128 * 128 * 2
    before = source.bytes
    zones = [s.box(i, 3 * i, i + 60, 3 * i + 40) for i in range(20)]
    r.zonal(zones, 1)
    assert source.bytes - before == tile
    r.zonal(zones, 9)
    r.pixels([s.x(0)], [s.y(0)], 9)
    assert source.bytes - before == tile
    before = source.bytes
    r.pixels([s.x(i / 7) for i in range(500)], [s.y(5)] * 500, 1)
    assert source.bytes - before == tile


def test_batch_equals_single_zones(paths):
    r, s = engine.open_raster(paths["strip"]), SCENES["strip"]
    zones = [s.box(9 * i, 2 * i, 9 * i + 40 + i, 2 * i + 30) for i in range(12)]
    assert r.zonal(zones, 1) == [r.zonal([z], 1)[0] for z in zones]


def test_workload_sees_the_same_pixels(paths):
    rows = dict(workload(paths["deflated"]))
    data = pixels("deflated")[0].astype(float)
    height, width = data.shape
    places = [(int(width * a), int(np.floor(height * (1 - b)))) for a, b in scattered()]
    assert rows["points_checksum"] == sum(data[y, x] for x, y in places)
    inside = data[(np.arange(height) + 0.5 >= height / 4) & (np.arange(height) + 0.5 <= height * 3 / 4)][:, (np.arange(width) + 0.5 >= width / 4) & (np.arange(width) + 0.5 <= width * 3 / 4)]
    assert rows["window_checksum"] == inside.sum()


# ------------------------------------------------------------------ sources and caches
def test_ranges():
    for source in (BytesSource(b"0123456789"),):
        assert source.read(8, 100) == b"89" and source.read_all() == b"0123456789"
        assert source.read_many([(8, 10), (0, 2), (1, 4)]) == [b"89", b"01", b"123"]
        with pytest.raises(EOFError):
            source.read(10, 11)
        with pytest.raises(ValueError):
            source.read(4, 2)


@pytest.fixture()
def server(paths):
    from pathlib import Path

    files = {f"/{k}": Path(p).read_bytes() for k, p in paths.items()}
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):  # noqa: N802
            calls.append(self.headers.get("Range"))
            path, _, flag = self.path.partition("?")
            if path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/hills")
                self.send_header("Content-Length", "0")
                self.end_headers()
                return
            data, status = files.get(path), 404
            if data is not None and flag == "whole":
                status = 200
            elif data is not None:
                a, b = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                status, data = (416, b"") if a >= len(data) else (206, data[a : b + 1])
            self.send_response(status)
            self.send_header("Content-Length", str(len(data or b"")))
            self.end_headers()
            self.wfile.write(data or b"")

        def log_message(self, *_):
            pass

    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", calls
    running.shutdown()


def test_http_ranges(server, paths):
    url, _ = server
    want = LocalSource(paths["hills"]).read(10, 50)
    for path in ("hills", "moved", "hills?whole"):
        assert HttpSource(f"{url}/{path}").read(10, 50) == want
    with pytest.raises(EOFError):
        HttpSource(f"{url}/hills").read(10**9, 10**9 + 5)
    with pytest.raises(OSError, match="404"):
        HttpSource(f"{url}/none").read(0, 5)
    with pytest.raises(OSError, match="cannot open"):
        open_source("http://127.0.0.1:1/x").read(0, 5)


def test_remote_rasters_and_tiles_are_cached(server, monkeypatch):
    url, calls = server
    now = [0.0]
    monkeypatch.setattr(cache, "tiles", cache.TileCache(10_000_000))
    monkeypatch.setattr(cache, "rasters", cache.OpenCache(60, lambda: now[0]))
    zones = [SCENES["hills"].box(i, i, i + 20, i + 50) for i in range(30)]
    for z in zones:
        engine.open_raster(f"{url}/hills").zonal([z], 1)
    assert len(calls) == 2 and cache.tiles.hits == 29 and cache.tiles.bytes == 128 * 128 * 2
    now[0] = 61
    engine.open_raster(f"{url}/hills").zonal(zones, 1)
    assert len(calls) == 4  # opened again, and nothing of the old tiles is used


def test_remote_reads_run_together_in_order(server, paths, monkeypatch):
    url, _ = server
    names = list(SCENES)
    found = engine.metas([f"{url}/{n}" for n in names] + [None, f"{url}/strip"])
    assert [found[f"{url}/{n}"].levels[0].width for n in names] == [s.width for s in SCENES.values()]
    with pytest.raises(ValueError, match="none1"):
        engine.metas([f"{url}/none1", f"{url}/strip", f"{url}/none2"])
    local = LocalSource(paths["hills"])
    spans = [(k * 60_000, k * 60_000 + 100) for k in (5, 1, 3, 0, 2, 4)]
    assert HttpSource(f"{url}/hills").read_many(spans) == [local.read(a, b) for a, b in spans]


def test_tile_cache_keeps_its_budget():
    held = cache.TileCache(1000)
    for i in range(10):
        held.put((1, i), np.zeros(300, np.uint8))
    assert held.bytes <= 1000 and held.evictions == 7 and held.get((1, 0)) is None and held.get((1, 9)) is not None
    held.put((2, 0), np.zeros(2000, np.uint8))
    assert held.get((2, 0)) is None
    off = cache.TileCache(0)
    off.put((1, 1), np.zeros(1, np.uint8))
    assert off.stats() == {"hits": 0, "misses": 0, "evictions": 0, "bytes": 0, "max_bytes": 0}


def test_open_cache_limit_and_off():
    made = []
    held = cache.OpenCache(60)
    for i in range(12):
        held.get(f"p{i}", lambda i=i: made.append(i) or i)
    assert len(held.held) == cache.OPEN_LIMIT and held.get("p11", lambda: 99) == 11
    assert cache.OpenCache(0).get("x", lambda: 5) == 5


def test_a_raster_of_many_tiles_opens_in_one_fetch(tmp_path):
    """Its 12,000 places of tiles do not fit the first window; they are read with the tiles."""
    bands = np.arange(3200 * 960, dtype=np.uint32).reshape(1, 3200, 960)
    for big in (False, True):
        data = write_cog(bands, tile=16, overviews=(2, 4), big=big, compression="none")
        (tmp_path / "many.tif").write_bytes(data)
        source = CountingSource(open_source(str(tmp_path / "many.tif")))
        raster = engine.Raster(source)
        assert source.fetches == 1 and source.bytes == 32_768 and [(t.width, t.height) for t in raster.meta.levels] == [(960, 3200), (480, 1600), (240, 800)]
        values, known = raster.band_array(1)
        assert known.all() and np.array_equal(values, bands.ravel())
        assert source.bytes < len(data) + 3 * 32_768
    (tmp_path / "cut.tif").write_bytes(data[:60_000])
    with pytest.raises(ValueError, match="file ends inside a directory"):
        engine.Raster(open_source(str(tmp_path / "cut.tif"))).band_array(1)
