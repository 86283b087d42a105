"""Metadata of a raster file: levels, georeference, nodata, band statistics and its tile grid."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from rasterspark.sources import tiff
from rasterspark.sources.bytesource import ByteSource

KEY_BITS = 24


class RasterError(ValueError):
    """A request that the raster cannot answer."""


def pack_key(level: int, x: int, y: int) -> int | None:
    """level << 48 | x << 24 | y, or None if x or y needs more than 24 bits."""
    if not (0 <= x < 1 << KEY_BITS and 0 <= y < 1 << KEY_BITS):
        return None
    return level << 2 * KEY_BITS | x << KEY_BITS | y


def unpack_key(key: int) -> tuple[int, int, int]:
    low = (1 << KEY_BITS) - 1
    return key >> 2 * KEY_BITS, key >> KEY_BITS & low, key & low


@dataclass(frozen=True)
class Georef:
    """North-up grid: x grows with columns by pixel_x, y falls with rows by pixel_y (both positive)."""

    epsg: int | None
    origin_x: float
    origin_y: float
    pixel_x: float
    pixel_y: float


@dataclass(frozen=True)
class BandStats:
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    stddev: float | None = None


@dataclass(frozen=True)
class Meta:
    levels: tuple[tiff.Tiling, ...]
    georef: Georef | None
    nodata: float | None
    stats: tuple[BandStats, ...] | None

    @property
    def bands(self) -> int:
        return self.levels[0].bands

    @property
    def srid(self) -> int:
        return self.georef.epsg or 0 if self.georef else 0

    @property
    def crs(self) -> str | None:
        return f"EPSG:{self.georef.epsg}" if self.georef and self.georef.epsg else None

    def need_georef(self) -> Georef:
        if self.georef is None:
            raise RasterError("raster has no georeference")
        return self.georef

    def georeference_text(self) -> str | None:
        if self.georef is None:
            return None
        g = self.georef
        return "\n".join(f"{v:.6f}" for v in (g.pixel_x, 0.0, 0.0, -g.pixel_y, g.origin_x, g.origin_y))

    def band_nodata(self, band: int) -> float | None:
        return self.nodata if 1 <= band <= self.bands else None

    def band_stats(self, band: int) -> BandStats | None:
        return self.stats[band - 1] if self.stats and 1 <= band <= len(self.stats) else None

    def world_to_grid(self, x: float, y: float) -> tuple[float, float]:
        """1-based column and row, unbounded."""
        g = self.need_georef()
        return math.floor((x - g.origin_x) / g.pixel_x) + 1, math.floor((g.origin_y - y) / g.pixel_y) + 1

    def grid_to_world(self, col: int, row: int) -> tuple[float, float]:
        """Top left corner of a 1-based pixel."""
        g = self.need_georef()
        return g.origin_x + (col - 1) * g.pixel_x, g.origin_y - (row - 1) * g.pixel_y

    def metadata(self) -> dict:
        g, top = self.georef, self.levels[0]
        return {
            "upperleftx": g and g.origin_x, "upperlefty": g and g.origin_y, "width": top.width, "height": top.height,
            "scalex": g and g.pixel_x, "scaley": g and -g.pixel_y, "skewx": g and 0.0, "skewy": g and 0.0, "srid": self.srid, "numbands": self.bands,
        }

    def tile_box(self, number: int, x: int, y: int) -> tuple[float, float, float, float] | None:
        """xmin, ymin, xmax, ymax of a tile, cut at the image; None without georeference."""
        g, base, level = self.georef, self.levels[0], self.levels[number]
        if g is None:
            return None
        px, py = g.pixel_x * (base.width / level.width), g.pixel_y * (base.height / level.height)
        left, above = x * level.tile_width, y * level.tile_height
        right, below = min(left + level.tile_width, level.width), min(above + level.tile_height, level.height)
        return g.origin_x + left * px, g.origin_y - below * py, g.origin_x + right * px, g.origin_y - above * py

    def level_tiles(self, number: int, first: int, last: int, bbox: list[float] | None = None) -> Iterator[tuple]:
        """Rows of one level's tiles in tile rows [first, last): see `tiles`."""
        level, xs, ys = self.levels[number], range(self.levels[number].tiles_x), range(first, last)
        if bbox is not None:
            g, base = self.need_georef(), self.levels[0]
            px, py = g.pixel_x * (base.width / level.width), g.pixel_y * (base.height / level.height)
            xs = _touched((bbox[0] - g.origin_x) / px, (bbox[2] - g.origin_x) / px, level.tile_width, xs)
            ys = _touched((g.origin_y - bbox[3]) / py, (g.origin_y - bbox[1]) / py, level.tile_height, ys)
        for y in ys:
            for x in xs:
                box = self.tile_box(number, x, y)
                if bbox is None or (box[0] <= bbox[2] and box[2] >= bbox[0] and box[1] <= bbox[3] and box[3] >= bbox[1]):
                    yield pack_key(number, x, y), number, x, y, level.tile_width, level.tile_height, box, self.crs

    def tiles(self, bbox: list[float] | None = None) -> Iterator[tuple]:
        """(id, level, tile_x, tile_y, cols, rows, bbox or None, crs) by level, row and column.

        A box keeps the tiles that it touches; only their ranges of rows and columns are walked.
        """
        if bbox is not None:
            check_bbox(bbox)
            self.need_georef()
        for number, level in enumerate(self.levels):
            yield from self.level_tiles(number, 0, level.tiles_y, bbox)


def _touched(low: float, high: float, size: int, among: range) -> range:
    """Numbers of the tiles between two pixel positions, with one to spare on both sides."""
    first = max(float(among.start), min(math.floor(low / size) - 1.0 if math.isfinite(low) else low, float(among.stop)))
    last = max(float(among.start), min(math.floor(high / size) + 2.0 if math.isfinite(high) else high, float(among.stop)))
    return range(int(first), int(last))


def check_bbox(bbox) -> None:
    if len(bbox) != 4:
        raise RasterError(f"bbox must have exactly 4 elements [xmin, ymin, xmax, ymax], got {len(bbox)}")
    if not all(math.isfinite(v) for v in bbox) or bbox[0] > bbox[2] or bbox[1] > bbox[3]:
        raise RasterError(f"bbox must be finite with xmin <= xmax and ymin <= ymax, got {list(bbox)}")


def read_meta(source: ByteSource) -> Meta:
    """Metadata from the directories alone; every directory is a level, the first one the full image."""
    directories = tiff.read_directories(source)
    if not directories:
        raise tiff.TiffError("file has no image")
    first = directories[0]
    levels = tuple(tiff.tiling(d) for d in directories)
    text = first.text(tiff.METADATA)
    return Meta(levels, _georef(first), _nodata(first.text(tiff.NODATA)), text and band_statistics(text, levels[0].bands) or None)


def _georef(d: tiff.Directory) -> Georef | None:
    scale, tie = d.tags.get(tiff.PIXEL_SCALE, ()), d.tags.get(tiff.TIEPOINT, ())
    if len(scale) < 2 or len(tie) < 6:
        return None
    keys, words = {}, d.tags.get(tiff.GEO_KEYS, ())
    for i in range(4, len(words) - 3, 4):
        if words[i + 1] == 0:
            keys[words[i]] = words[i + 3]
    epsg = keys.get(tiff.PROJECTED_KEY) or keys.get(tiff.GEOGRAPHIC_KEY)
    return Georef(epsg, tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1], float(scale[0]), float(scale[1]))


def _nodata(text: str | None) -> float | None:
    try:
        return float(text.strip()) if text is not None and "_" not in text else None
    except ValueError:
        return None


_ITEM = re.compile(r"<Item\s([^>]*)>([^<]*)<")
_FIELDS = {"STATISTICS_MINIMUM": "min", "STATISTICS_MAXIMUM": "max", "STATISTICS_MEAN": "mean", "STATISTICS_STDDEV": "stddev"}


def band_statistics(text: str, bands: int) -> tuple[BandStats, ...] | None:
    """Statistics items of a metadata text by band; a sample that is not given is the first band's."""
    found: list[dict] = [{} for _ in range(bands)]
    for attributes, value in _ITEM.findall(text):
        given = dict(re.findall(r'(\w+)="([^"]*)"', attributes))
        field = _FIELDS.get(given.get("name", ""))
        sample = given.get("sample", "0")
        band = int(sample) if sample.isdigit() else 0
        if field is None or band >= bands:
            continue
        try:
            found[band][field] = float(value.strip())
        except ValueError:
            continue
    return tuple(BandStats(**f) for f in found) if any(found) else None
