"""Rasters and zones of the tests, and what is expected of them by plain loops over their pixels."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np

from rasterspark.sources.cogwrite import write_cog

EPSG = 32633


@dataclass(frozen=True)
class Scene:
    """A raster whose pixels follow from a rule, with square pixels of `pixel` units."""

    width: int
    height: int
    bands: int = 1
    kind: str = "u2"
    left: float = 412_000
    top: float = 5_307_000
    pixel: float = 20
    tile: int = 128
    nodata: str | None = "0"
    compression: str = "none"
    overviews: tuple[int, ...] = ()
    holes: bool = False
    described: bool = False

    @property
    def right(self) -> float:
        return self.left + self.width * self.pixel

    @property
    def bottom(self) -> float:
        return self.top - self.height * self.pixel

    def x(self, col: float) -> float:
        """The centre of a column; fractions of a column lie between."""
        return self.left + (col + 0.5) * self.pixel

    def y(self, row: float) -> float:
        return self.top - (row + 0.5) * self.pixel

    def box(self, c0: int, r0: int, c1: int, r1: int) -> list[float]:
        """The box of the edges of columns c0..c1 and rows r0..r1."""
        return [self.left + c0 * self.pixel, self.top - (r1 + 1) * self.pixel, self.left + (c1 + 1) * self.pixel, self.top - r0 * self.pixel]

    def wkt(self, *polygons: list[list[tuple[float, float]]]) -> str:
        """Polygons (an outer ring and its holes, in pixel corners) as WKT in world units."""
        ring = lambda points: "(" + ", ".join(f"{self.left + c * self.pixel!r} {self.top - r * self.pixel!r}" for c, r in [*points, points[0]]) + ")"
        bodies = ["(" + ", ".join(map(ring, p)) + ")" for p in polygons]
        return f"POLYGON {bodies[0]}" if len(bodies) == 1 else f"MULTIPOLYGON ({', '.join(bodies)})"


SCENES = {
    "hills": Scene(520, 410, overviews=(2, 4)),
    "strip": Scene(333, 97, left=-20_000, top=880_000, pixel=8, tile=64, overviews=(2,)),
    "trio": Scene(48, 40, bands=3, kind="u1", left=1000, top=2000, pixel=5, tile=32, nodata=None),
    "speck": Scene(12, 9, kind="u1", left=0, top=90, pixel=1, tile=16, nodata=None),
    "deflated": Scene(150, 110, tile=64, compression="deflate"),
    "zstandard": Scene(150, 110, tile=64, compression="zstd"),
    "lempel": Scene(150, 110, tile=64, compression="lzw"),
    "holes": Scene(50, 44, tile=32, holes=True),
    "described": Scene(50, 44, tile=32, described=True),
}

# Zones over `hills`, in pixel corners; no corner or edge meets a pixel's centre.
ELL = [[(60.3, 100.3), (300.3, 100.3), (300.3, 180.3), (150.3, 180.3), (150.3, 330.3), (60.3, 330.3)], [(80.3, 120.3), (120.3, 120.3), (120.3, 165.3), (80.3, 165.3)]]
PAIR = [[[(10.3, 10.3), (40.3, 5.3), (70.3, 30.3), (35.3, 60.3)]], [[(250.3, 250.3), (262.3, 250.3), (262.3, 275.3), (250.3, 275.3)]]]
SLIVER = [[(5.3, 400.3), (500.3, 380.3), (505.3, 395.3)]]
ZONES = {"ell": [ELL], "pair": PAIR, "sliver": [SLIVER]}


@cache
def pixels(name: str) -> np.ndarray:
    s = SCENES[name]
    band, row, col = np.mgrid[0 : s.bands, 0 : s.height, 0 : s.width]
    rule = col * 7919 + row * 104_729 + band * 611_953 + (col * row) % 1009 * 31
    data = rule % (251 if s.kind == "u1" else 65_521) + (0 if s.nodata is None else 1)
    if s.holes:
        data[0, np.arange(0, s.height, 3), np.arange(0, s.height, 3)] = 0
    return data.astype(s.kind)


def value(name: str, col: int, row: int, band: int = 1) -> int:
    return int(pixels(name)[band - 1, row, col])


def zone(name: str) -> str:
    return SCENES["hills"].wkt(*ZONES[name])


@cache
def in_zone(name: str, zone_name: str) -> tuple[int, ...]:
    """The values of a scene's pixels whose centres lie in a zone, by crossing counts, without nodata."""
    s, out = SCENES[name], []
    edges = [(p, q) for polygon in ZONES[zone_name] for ring in polygon for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)]
    for row in range(s.height):
        y = row + 0.5
        crossed = [x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in edges if (y1 > y) != (y2 > y)]
        for col in range(s.width):
            if sum(x > col + 0.5 for x in crossed) % 2:
                out.append(value(name, col, row))
    return tuple(v for v in out if s.nodata is None or v != float(s.nodata))


def in_window(name: str, c0: int, r0: int, c1: int, r1: int, band: int = 1) -> list[int]:
    """The values of a window, row by row."""
    return [value(name, c, r, band) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)]


def tiles_of(name: str) -> int:
    s = SCENES[name]
    return sum(-(-(-(-s.width // f)) // s.tile) * -(-(-(-s.height // f)) // s.tile) for f in (1, *s.overviews))


def make(folder: Path) -> dict[str, str]:
    """Write all rasters and return their paths."""
    out = {}
    for name, s in SCENES.items():
        data, metadata = pixels(name), None
        if s.described:
            found = {"MINIMUM": data.min(), "MAXIMUM": data.max(), "MEAN": data.mean(), "STDDEV": data.std()}
            metadata = "<GDALMetadata>" + "".join(f'<Item name="STATISTICS_{k}" sample="0">{float(v):.6f}</Item>' for k, v in found.items()) + "</GDALMetadata>"
        path = folder / f"{name}.tif"
        path.write_bytes(write_cog(data, tile=s.tile, overviews=s.overviews, origin=(s.left, s.top), pixel=(s.pixel, s.pixel), epsg=EPSG, nodata=s.nodata, metadata=metadata, compression=s.compression))
        out[name] = str(path)
    return out
