"""Pixels, windows and zonal statistics of an opened raster (level 0), vectorised per tile."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np

from rasterspark.functions import cache
from rasterspark.functions.model import Meta, check_bbox, read_meta
from rasterspark.functions.zone import Zone
from rasterspark.sources.bytesource import BytesSource, ByteSource, concurrently, is_remote, open_source

TILES_AT_ONCE = 16
STATS = ("count", "sum", "mean", "min", "max")


@dataclass
class Stats:
    """A partial aggregate of pixels; min and max ignore NaN unless all are NaN."""

    count: int = 0
    sum: float = 0.0
    min: float | None = None
    max: float | None = None

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        low, high = float(np.fmin.reduce(values)), float(np.fmax.reduce(values))
        self.min = low if self.min is None else float(np.fmin(self.min, low))
        self.max = high if self.max is None else float(np.fmax(self.max, high))
        self.count += len(values)
        self.sum += float(values.sum(dtype=np.float64))

    def value(self, stat: str) -> float | None:
        if stat == "count":
            return float(self.count)
        if not self.count:
            return None
        return self.sum / self.count if stat == "mean" else getattr(self, stat)


def stat_name(stat: str) -> str:
    low = stat.lower()
    if low not in STATS:
        raise ValueError(f"unknown stat '{low}' (count/sum/mean/min/max)")
    return low


@dataclass(frozen=True)
class Window:
    """Columns c0..c1 and rows r0..r1 of the image, ends included."""

    c0: int
    c1: int
    r0: int
    r1: int

    @property
    def width(self) -> int:
        return self.c1 - self.c0 + 1

    @property
    def height(self) -> int:
        return self.r1 - self.r0 + 1

    def tiles(self, tile_width: int, tile_height: int) -> list[tuple[int, int]]:
        return [(x, y) for y in range(self.r0 // tile_height, self.r1 // tile_height + 1) for x in range(self.c0 // tile_width, self.c1 // tile_width + 1)]


class Raster:
    """An opened file. Opening reads the directories; pixels are read when asked for."""

    def __init__(self, source: ByteSource, cached: bool = False):
        self.source, self.meta = source, read_meta(source)
        self.number = next(cache.reader_numbers) if cached and cache.tiles.limit else None

    @property
    def top(self):
        return self.meta.levels[0]

    def tiles(self, wanted: Sequence[tuple[int, int]]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        """Each wanted tile as (bands, rows, cols); a group's byte ranges are fetched together.

        A cached raster's tile that another thread is fetching is waited for and not fetched again.
        """
        for k in range(0, len(wanted), TILES_AT_ONCE):
            group, ready, mine, theirs = wanted[k : k + TILES_AT_ONCE], {}, [], []
            for t in dict.fromkeys(group):
                if self.number is None:
                    mine.append(t)
                    continue
                tile, first = cache.tiles.claim((self.number, *t))
                if tile is not None:
                    ready[t] = tile
                else:
                    (mine if first else theirs).append(t)
            try:
                ready |= self._fetch(mine)
            finally:
                if self.number is not None:
                    for t in mine:
                        cache.tiles.settle((self.number, *t), ready.get(t))
            again = []
            for t in theirs:
                if (tile := cache.tiles.wait((self.number, *t))) is None:
                    again.append(t)  # the other thread failed, or the tile is gone already
                else:
                    ready[t] = tile
            ready |= self._fetch(again)
            for t in group:
                yield t, ready[t]

    def _fetch(self, wanted: Sequence[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        spans = [self.top.ranges(*t) for t in wanted]
        whole = [r for s in spans for r in s if r[1] > r[0]]
        parts = iter(self.source.read_many(whole)) if whole else iter(())
        raw = [[next(parts) if r[1] > r[0] else b"" for r in span] for span in spans]
        # decompression leaves the interpreter's lock to other threads
        return dict(zip(wanted, concurrently(lambda x: self.top.decode(x, self.meta.nodata), raw), strict=True))

    def valid(self, values: np.ndarray) -> np.ndarray:
        """Which float64 values are not nodata."""
        nodata = self.meta.nodata
        if nodata is None:
            return np.ones(values.shape, bool)
        return ~np.isnan(values) if math.isnan(nodata) else values != nodata

    def has_band(self, band: int) -> bool:
        return 1 <= band <= self.meta.bands

    def pixels(self, xs: Sequence[float | None], ys: Sequence[float | None], band: int) -> tuple[np.ndarray, np.ndarray]:
        """Values at points and which of them exist: None, outside and nodata points do not.

        Every tile is read once, however many points it has.
        """
        g, top, n = self.meta.need_georef(), self.top, len(xs)
        values, known = np.zeros(n), np.zeros(n, bool)
        if not self.has_band(band):
            return values, known
        x, y = (np.array([math.nan if v is None else v for v in a], float) for a in (xs, ys))
        with np.errstate(invalid="ignore"):
            col, row = np.floor((x - g.origin_x) / g.pixel_x), np.floor((g.origin_y - y) / g.pixel_y)
            inside = np.flatnonzero((col >= 0) & (col < top.width) & (row >= 0) & (row < top.height))
        col, row = col[inside].astype(np.int64), row[inside].astype(np.int64)
        slot = (row // top.tile_height) * top.tiles_x + col // top.tile_width
        order = np.argsort(slot, kind="stable")
        edges = np.flatnonzero(np.diff(slot[order], prepend=-1))
        wanted = [(int(s % top.tiles_x), int(s // top.tiles_x)) for s in slot[order][edges]]
        for ((tx, ty), tile), at in zip(self.tiles(wanted), np.split(order, edges[1:]), strict=False):
            got = tile[band - 1, row[at] - ty * top.tile_height, col[at] - tx * top.tile_width].astype(np.float64)
            values[inside[at]] = got
            known[inside[at]] = self.valid(got)
        return values, known

    def window(self, box: Sequence[float]) -> Window | None:
        """The pixels whose centres lie in a closed box; None if there are none."""
        g, top = self.meta.need_georef(), self.top
        limit = lambda v, low, high: int(min(max(v, low), high))
        c0, c1 = limit(math.ceil((box[0] - g.origin_x) / g.pixel_x - 0.5), 0, top.width), limit(math.floor((box[2] - g.origin_x) / g.pixel_x - 0.5), -1, top.width - 1)
        r0, r1 = limit(math.ceil((g.origin_y - box[3]) / g.pixel_y - 0.5), 0, top.height), limit(math.floor((g.origin_y - box[1]) / g.pixel_y - 0.5), -1, top.height - 1)
        return Window(c0, c1, r0, r1) if c0 <= c1 and r0 <= r1 else None

    def cut(self, window: Window, tile: tuple[int, int]) -> Window:
        """The part of a window inside a tile."""
        top = self.top
        left, above = tile[0] * top.tile_width, tile[1] * top.tile_height
        return Window(max(window.c0, left), min(window.c1, left + top.tile_width - 1), max(window.r0, above), min(window.r1, above + top.tile_height - 1))

    def centres(self, part: Window) -> tuple[np.ndarray, np.ndarray]:
        g = self.meta.need_georef()
        return g.origin_x + (np.arange(part.c0, part.c1 + 1) + 0.5) * g.pixel_x, g.origin_y - (np.arange(part.r0, part.r1 + 1) + 0.5) * g.pixel_y

    def block(self, tile: tuple[int, int], data: np.ndarray, part: Window, band: int) -> np.ndarray:
        left, above = tile[0] * self.top.tile_width, tile[1] * self.top.tile_height
        return data[band - 1, part.r0 - above : part.r1 - above + 1, part.c0 - left : part.c1 - left + 1].astype(np.float64)

    def zone_window(self, zone: Zone | Sequence[float], band: int) -> Window | None:
        """The window that a zone needs, after the checks in their order: box, georeference, band."""
        if not isinstance(zone, Zone):
            check_bbox(zone)
        self.meta.need_georef()
        if not self.has_band(band):
            return None
        box = zone.envelope() if isinstance(zone, Zone) else zone
        return self.window(box) if box is not None else None

    def inside(self, zone: Zone | Sequence[float], part: Window) -> np.ndarray | None:
        return zone.mask(*self.centres(part)) if isinstance(zone, Zone) else None

    def zonal(self, zones: Sequence[Zone | Sequence[float]], band: int) -> list[Stats]:
        """Statistics of several zones; the union of their tiles is read once."""
        out = [Stats() for _ in zones]
        by_tile: dict[tuple[int, int], list[int]] = {}
        windows = [self.zone_window(z, band) for z in zones]
        for i, w in enumerate(windows):
            for t in w.tiles(self.top.tile_width, self.top.tile_height) if w else ():
                by_tile.setdefault(t, []).append(i)
        order = sorted(by_tile, key=lambda t: (t[1], t[0]))
        for t, data in self.tiles(order):
            for i in by_tile[t]:
                out[i].add(self.tile_values(t, data, zones[i], windows[i], band))
        return out

    def tile_values(self, tile: tuple[int, int], data: np.ndarray, zone: Zone | Sequence[float], window: Window, band: int) -> np.ndarray:
        """The valid values of a zone inside one tile."""
        part = self.cut(window, tile)
        values = self.block(tile, data, part, band)
        keep = self.valid(values)
        if (mask := self.inside(zone, part)) is not None:
            keep &= mask
        return values[keep]

    def band_array(self, band: int, zone: Zone | Sequence[float] | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Row-major values and which exist; None for a bad band, empty for a window without pixels."""
        if not self.has_band(band):
            return None
        if zone is None:
            window = Window(0, self.top.width - 1, 0, self.top.height - 1)
        else:
            window = self.zone_window(zone, band)
        if window is None:
            return np.empty(0), np.empty(0, bool)
        values, known = np.zeros((window.height, window.width)), np.zeros((window.height, window.width), bool)
        for t, data in self.tiles(window.tiles(self.top.tile_width, self.top.tile_height)):
            part = self.cut(window, t)
            got = self.block(t, data, part, band)
            keep = self.valid(got)
            if zone is not None and (mask := self.inside(zone, part)) is not None:
                keep &= mask
            at = np.s_[part.r0 - window.r0 : part.r1 - window.r0 + 1, part.c0 - window.c0 : part.c1 - window.c0 + 1]
            values[at], known[at] = got, keep
        return values.ravel(), known.ravel()


def normalized_difference(v1: float | None, v2: float | None) -> float | None:
    """(v2 - v1) / (v2 + v1); None if a value is missing or the sum is 0."""
    if v1 is None or v2 is None or v1 + v2 == 0:
        return None
    return (v2 - v1) / (v2 + v1)


def open_raster(path: str | bytes) -> Raster:
    """Open a path, URI or a file's content; remote rasters are kept for a while."""
    if isinstance(path, bytes):
        return Raster(BytesSource(path))
    if is_remote(path):
        return cache.rasters.get(path, lambda: Raster(open_source(path), cached=True))
    return Raster(open_source(path))


def together(run: Callable, items: Sequence, paths: Sequence[str | bytes]) -> None:
    """run(item) of all items, several at a time where their files are remote; the first error in their order is raised."""
    remote = [isinstance(p, str) and is_remote(p) for p in paths]
    ahead = iter(concurrently(run, [i for i, far in zip(items, remote, strict=True) if far]))
    for item, far in zip(items, remote, strict=True):
        next(ahead) if far else run(item)


class Opener:
    """Opens each distinct path of a batch once; an error names the path."""

    def __init__(self):
        self.held: dict[str | bytes, Raster] = {}

    def __call__(self, path: str | bytes) -> Raster:
        if path not in self.held:
            try:
                self.held[path] = open_raster(path)
            except (OSError, ValueError, EOFError) as e:
                name = path if isinstance(path, str) else f"{len(path)} bytes"
                raise ValueError(str(e) if str(name) in str(e) else f"'{name}': {e}") from e
        return self.held[path]

    def ahead(self, paths: Sequence[str | bytes | None]) -> None:
        """Open the distinct remote paths of a batch, several at a time; the first error in their order is raised."""
        new = [p for p in dict.fromkeys(paths) if isinstance(p, str) and is_remote(p) and p not in self.held]
        for _ in concurrently(self, new):
            pass


def metas(paths: Sequence[str | bytes | None]) -> dict[str | bytes, Meta]:
    """Metadata of the distinct paths."""
    opener = Opener()
    opener.ahead(paths)
    return {p: opener(p).meta for p in dict.fromkeys(paths) if p is not None}
