"""The RS_* scalar functions as Arrow UDFs under their SQL names.

The first argument is a path or URI, or a file's content as binary. A batch opens each distinct file once and
reads each tile once. A null argument gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf

from rasterspark.functions import engine
from rasterspark.functions.model import Meta
from rasterspark.functions.types import arrow_type, spark_type
from rasterspark.functions.zone import parse

METADATA = "struct<upperleftx:double,upperlefty:double,width:int,height:int,scalex:double,scaley:double,skewx:double,skewy:double,srid:int,numbands:int>"
STATS = "struct<count:bigint,sum:double,mean:double,min:double,max:double>"
BAND_STATS = "struct<min:double,max:double,mean:double,stddev:double>"
_I32 = 1 << 31


def _list(column: pa.Array) -> list:
    return column.to_pylist()


def _numbers(column: pa.Array | None, n: int, default=None) -> list:
    """Python floats or ints of a numeric column; decimals become floats."""
    if column is None:
        return [default] * n
    if pa.types.is_integer(column.type):
        return column.to_pylist()
    return column.cast(pa.float64()).to_pylist() if not pa.types.is_null(column.type) else [None] * n


def _bands(column: pa.Array | None, n: int) -> list[int | None]:
    return [None if b is None else int(b) for b in _numbers(column, n, 1)]


def _zones(column: pa.Array) -> list:
    """Boxes of a list column or zones of a text column; a box with a null element is null."""
    if pa.types.is_null(column.type):
        return [None] * len(column)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return [None if t is None else parse(t) for t in column.to_pylist()]
    boxes = [None if z is None or any(v is None for v in z) else [float(v) for v in z] for z in column.to_pylist()]
    return boxes


def _errors(name: str, run: Callable) -> Callable:
    """Errors carry the function's name."""

    def guarded(*columns: pa.Array, **named: pa.Array) -> pa.Array:
        try:
            return run(*columns, **named)
        except (ValueError, OSError, EOFError) as e:
            raise ValueError(f"{name}: {e}") from e

    return guarded


def _of_meta(ddl: str, get: Callable[[Meta], object]) -> Callable:
    def run(path: pa.Array) -> pa.Array:
        paths = _list(path)
        found = engine.metas(paths)
        return pa.array([None if p is None else get(found[p]) for p in paths], arrow_type(ddl))

    return run


def _of_meta_and_band(ddl: str, get: Callable[[Meta, int], object]) -> Callable:
    def run(path: pa.Array, band: pa.Array | None = None) -> pa.Array:
        paths = _list(path)
        found, bands = engine.metas(paths), _bands(band, len(paths))
        return pa.array([None if p is None or b is None else get(found[p], b) for p, b in zip(paths, bands, strict=True)], arrow_type(ddl))

    return run


def _floats(column: pa.Array | None, n: int) -> np.ndarray:
    """A numeric column as float64, null as NaN."""
    if column is None or pa.types.is_null(column.type):
        return np.full(n, np.nan)
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _groups(keys: Sequence) -> list[tuple[object, np.ndarray]]:
    """The distinct keys but None in their order, each with the places that have it."""
    coded = pa.array(keys).dictionary_encode() if len(keys) else pa.array([], pa.string()).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    return [(k, order[a:b]) for k, a, b in zip(coded.dictionary.to_pylist(), edges[:-1], edges[1:], strict=True)]


def _world_to_raster(path: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    n = len(path)
    paths, xs, ys = _list(path), _floats(x, n), _floats(y, n)
    given = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
    found, cells, fits = engine.metas(paths), np.zeros((2, n)), np.zeros(n, bool)
    for p, at in _groups(paths):
        at = at[given[at]]
        if len(at):
            g = found[p].need_georef()
            cells[:, at] = np.floor((xs[at] - g.origin_x) / g.pixel_x) + 1, np.floor((g.origin_y - ys[at]) / g.pixel_y) + 1
            fits[at] = (np.isfinite(cells[:, at]) & (cells[:, at] >= -_I32) & (cells[:, at] < _I32)).all(axis=0)
    whole = np.where(fits, cells, 0).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(whole[0]), pa.array(whole[1])], ["col", "row"], mask=pa.array(~fits))


def _raster_to_world(path: pa.Array, col: pa.Array, row: pa.Array) -> pa.Array:
    n = len(path)
    paths, cols, rows = _list(path), np.trunc(_floats(col, n)), np.trunc(_floats(row, n))
    found, spots, known = engine.metas(paths), np.zeros((2, n)), np.zeros(n, bool)
    for p, at in _groups(paths):
        at = at[np.isfinite(cols[at]) & np.isfinite(rows[at])]
        if len(at):
            g = found[p].need_georef()
            spots[:, at] = g.origin_x + (cols[at] - 1) * g.pixel_x, g.origin_y - (rows[at] - 1) * g.pixel_y
            known[at] = True
    return pa.StructArray.from_arrays([pa.array(spots[0]), pa.array(spots[1])], ["x", "y"], mask=pa.array(~known))


def _points(path: pa.Array, x: pa.Array, y: pa.Array, bands: Sequence[pa.Array | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Values of each band column at the rows' points and which exist; rasters of a batch are read at the same time."""
    n = len(path)
    paths, xs, ys = _list(path), _floats(x, n), _floats(y, n)
    numbers = [np.ones(n) if b is None else np.trunc(_floats(b, n)) for b in bands]
    whole = np.ones(n, bool)
    for column in (x, y, *(b for b in bands if b is not None)):
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
    values, known = [np.zeros(n) for _ in bands], [np.zeros(n, bool) for _ in bands]
    groups = [(p, at[whole[at]]) for p, at in _groups(paths)]
    groups = [(p, at) for p, at in groups if len(at)]
    opener = engine.Opener()
    opener.ahead([p for p, _ in groups])

    def read(group: tuple) -> None:
        p, rows = group
        raster = opener(p)
        for k, own in enumerate(numbers):
            for b in np.unique(own[rows]).tolist():
                at = rows[own[rows] == b]
                values[k][at], known[k][at] = raster.pixels(xs[at], ys[at], int(b))

    engine.together(read, groups, [p for p, _ in groups])
    return values, known


def _value(path: pa.Array, x: pa.Array, y: pa.Array, band: pa.Array | None = None) -> pa.Array:
    (values,), (known,) = _points(path, x, y, [band])
    return pa.array(values, mask=~known)


def _difference(path: pa.Array, x: pa.Array, y: pa.Array, band1: pa.Array, band2: pa.Array) -> pa.Array:
    (v1, v2), (k1, k2) = _points(path, x, y, [band1, band2])
    total = v1 + v2
    known = k1 & k2 & (total != 0)
    return pa.array(np.divide(v2 - v1, total, out=np.zeros_like(total), where=known), mask=~known)


def _values(path: pa.Array, xs: pa.Array, ys: pa.Array, band: pa.Array | None = None) -> pa.Array:
    rows = list(zip(_list(path), _list(xs), _list(ys), _bands(band, len(path)), strict=True))
    live = [i for i, row in enumerate(rows) if not any(v is None for v in row)]
    for i in live:
        if len(rows[i][1]) != len(rows[i][2]):
            raise ValueError(f"xs has {len(rows[i][1])} elements and ys {len(rows[i][2])}")
    opener, out = engine.Opener(), [None] * len(rows)
    opener.ahead([rows[i][0] for i in live])

    def read(i: int) -> None:
        p, a, b, k = rows[i]
        one = lambda v, w: None if v is None or w is None else float(v)
        values, known = opener(p).pixels([one(v, w) for v, w in zip(a, b, strict=True)], [one(w, v) for v, w in zip(a, b, strict=True)], k)
        out[i] = [v if ok else None for v, ok in zip(values.tolist(), known.tolist(), strict=True)]

    engine.together(read, live, [rows[i][0] for i in live])
    return pa.array(out, pa.list_(pa.float64()))


def _band_array(path: pa.Array, band: pa.Array, zone: pa.Array | None = None) -> pa.Array:
    n = len(path)
    zones = _zones(zone) if zone is not None else [None] * n
    opener, out = engine.Opener(), []
    for p, b, z in zip(_list(path), _bands(band, n), zones, strict=True):
        if p is None or b is None or (zone is not None and z is None):
            out.append(None)
            continue
        got = opener(p).band_array(b, z)
        out.append(None if got is None else pa.array(got[0], mask=~got[1]).to_pylist())
    return pa.array(out, pa.list_(pa.float64()))


def _zonal_rows(path: pa.Array, zones: list, bands: list) -> list[engine.Stats | None]:
    """Statistics of each row; rows of one file and band share the reading of tiles, and remote files are read at the same time."""
    out: list[engine.Stats | None] = [None] * len(zones)
    opener, groups = engine.Opener(), {}
    for i, (p, z, b) in enumerate(zip(_list(path), zones, bands, strict=True)):
        if p is not None and z is not None and b is not None:
            groups.setdefault((p, b), []).append(i)
    opener.ahead([p for p, _ in groups])
    for p, _ in groups:
        opener(p)

    def read(group: tuple) -> None:
        (p, b), rows = group
        for i, s in zip(rows, opener(p).zonal([zones[i] for i in rows], b), strict=True):
            out[i] = s

    engine.together(read, list(groups.items()), [p for p, _ in groups])
    return out


def _zonal(path: pa.Array, zone: pa.Array, band: pa.Array, stat: pa.Array) -> pa.Array:
    names = [None if s is None else engine.stat_name(s) for s in _list(stat)]
    bands = [b if s is not None else None for b, s in zip(_bands(band, len(path)), names, strict=True)]
    rows = _zonal_rows(path, _zones(zone), bands)
    return pa.array([None if r is None else r.value(s) for r, s in zip(rows, names, strict=True)], pa.float64())


def _zonal_all(path: pa.Array, zone: pa.Array, band: pa.Array | None = None) -> pa.Array:
    rows = _zonal_rows(path, _zones(zone), _bands(band, len(path)))
    return pa.array([None if r is None else {"count": r.count, **{s: r.value(s) for s in ("sum", "mean", "min", "max")}} for r in rows], arrow_type(STATS))


def _zonal_batch(path: pa.Array, zones: pa.Array, band: pa.Array, stat: pa.Array) -> pa.Array:
    opener, out = engine.Opener(), []
    names = [None if s is None else engine.stat_name(s) for s in _list(stat)]
    for p, texts, b, s in zip(_list(path), _list(zones), _bands(band, len(path)), names, strict=True):
        if None in (p, b, s) or texts is None:
            out.append(None)
            continue
        known = [parse(t) for t in texts if t is not None]
        got = iter(opener(p).zonal(known, b))
        out.append([None if t is None else next(got).value(s) for t in texts])
    return pa.array(out, pa.list_(pa.float64()))


def _stats_of(meta: Meta, band: int) -> dict | None:
    found = meta.band_stats(band)
    return None if found is None else vars(found)


def _field(name: str) -> Callable[[Meta], object]:
    return lambda meta: meta.metadata()[name]


FUNCTIONS: dict[str, tuple[str, Callable]] = {
    **{f"RS_{n}": ("int", _of_meta("int", _field(k))) for n, k in (("Width", "width"), ("Height", "height"), ("NumBands", "numbands"), ("SRID", "srid"))},
    **{f"RS_{n}": ("double", _of_meta("double", _field(n.lower()))) for n in ("ScaleX", "ScaleY", "SkewX", "SkewY", "UpperLeftX", "UpperLeftY")},
    "RS_GeoReference": ("string", _of_meta("string", Meta.georeference_text)),
    "RS_MetaData": (METADATA, _of_meta(METADATA, Meta.metadata)),
    "RS_BandNoDataValue": ("double", _of_meta_and_band("double", Meta.band_nodata)),
    "RS_BandStats": (BAND_STATS, _of_meta_and_band(BAND_STATS, _stats_of)),
    "RS_WorldToRasterCoord": ("struct<col:int,row:int>", _world_to_raster),
    "RS_RasterToWorldCoord": ("struct<x:double,y:double>", _raster_to_world),
    "RS_Value": ("double", _value),
    "RS_Values": ("array<double>", _values),
    "RS_NormalizedDifference": ("double", _difference),
    "RS_BandAsArray": ("array<double>", _band_array),
    "RS_ZonalStats": ("double", _zonal),
    "RS_ZonalStatsAll": (STATS, _zonal_all),
    "RS_ZonalStatsBatch": ("array<double>", _zonal_batch),
}


def _typed(run: Callable, ddl: str):
    def one(*columns: pa.Array, **named: pa.Array) -> pa.Array:
        return run(*columns, **named)

    return arrow_udf(one, spark_type(ddl))


UDFS = {name: _typed(_errors(name, run), ddl) for name, (ddl, run) in FUNCTIONS.items()}


def register(spark: SparkSession) -> None:
    """Register every function, table function and data source of the package on a session."""
    from rasterspark.functions import tables
    from rasterspark.sources import datasource

    for name, function in UDFS.items():
        spark.udf.register(name, function)
    tables.register(spark)
    datasource.register(spark)
