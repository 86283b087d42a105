"""Polygon zones: WKT, envelopes and masks of pixel centres."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

_LEXEME = re.compile(r"\s*(?:([A-Za-z]+)|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([(),]))")
# Geometry names of WKT that are no zones.
_OTHERS = frozenset("POINT LINESTRING MULTIPOINT MULTILINESTRING GEOMETRYCOLLECTION".split())


class ZoneError(ValueError):
    """Text that is no POLYGON or MULTIPOLYGON."""


@dataclass(frozen=True)
class Zone:
    """Polygons as tuples of rings; a ring is an (n, 2) array, the first of a polygon its exterior."""

    polygons: tuple[tuple[np.ndarray, ...], ...]

    def envelope(self) -> list[float] | None:
        """[xmin, ymin, xmax, ymax] of the exteriors; None if there are none."""
        shells = [p[0] for p in self.polygons if p and len(p[0])]
        if not shells:
            return None
        points = np.concatenate(shells)
        return [*points.min(axis=0).tolist(), *points.max(axis=0).tolist()]

    def edges(self) -> np.ndarray:
        """(n, 4) of x1, y1, x2, y2 over all rings, each closed."""
        parts = [np.column_stack([np.roll(r, 1, axis=0), r]) for p in self.polygons for r in p if len(r) >= 2]
        return np.concatenate(parts) if parts else np.empty((0, 4))

    def mask(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Which of the centres (y of ys, x of xs, xs ascending) have odd crossings to the right.

        Each edge flips, in the rows that it spans, the centres left of its crossing: one mark at the end of that
        stretch for each row and edge, then one running parity from the right for all.
        """
        flips = np.zeros((len(ys), len(xs) + 1), np.uint32)
        for x1, y1, x2, y2 in self.edges():
            rows = np.flatnonzero((y2 > ys) != (y1 > ys))
            if len(rows):
                crossing = x1 + (ys[rows] - y1) * (x2 - x1) / (y2 - y1)
                np.add.at(flips, (rows, np.searchsorted(xs, crossing, "left")), 1)
        # a centre at position c is left of a crossing marked at k if c < k
        return (np.cumsum(flips[:, ::-1], axis=1)[:, ::-1][:, 1:] & 1).astype(bool)


@lru_cache(maxsize=4096)
def parse(text: str) -> Zone:
    """A zone from WKT, POLYGON or MULTIPOLYGON, EMPTY allowed; further ordinates are dropped."""
    lexemes, at = [], 0
    stripped = text.strip()
    while at < len(stripped):
        m = _LEXEME.match(stripped, at)
        if m is None or m.end() == at:
            raise ZoneError(f"invalid WKT zone: unexpected text at {at}")
        lexemes.append(m.group(m.lastindex))
        at = m.end()
    lexemes.reverse()

    def take(expected: str | None = None) -> str:
        got = lexemes.pop() if lexemes else ""
        if not got or (expected is not None and got not in expected):
            raise ZoneError(f"invalid WKT zone: expected {expected or 'more'}, got '{got}'")
        return got

    def many(item):
        if lexemes and lexemes[-1].upper() == "EMPTY":
            lexemes.pop()
            return ()
        take("(")
        out = [item()]
        while take(",)") == ",":
            out.append(item())
        return tuple(out)

    def point():
        numbers = []
        while lexemes and lexemes[-1] not in ",()":
            try:
                numbers.append(float(lexemes.pop()))
            except ValueError as e:
                raise ZoneError(f"invalid WKT zone: {e}") from None
        if not 2 <= len(numbers) <= 4:
            raise ZoneError("invalid WKT zone: a point needs two to four numbers")
        if not all(map(math.isfinite, numbers[:2])):
            raise ZoneError("zone coordinates must be finite")
        return numbers[:2]

    def ring():
        return np.array(many(point), float).reshape(-1, 2)

    kind = take().upper()
    if kind in _OTHERS:
        raise ZoneError(f"unsupported zone type {kind} (POLYGON/MULTIPOLYGON only)")
    if lexemes and lexemes[-1].upper() in ("Z", "M", "ZM"):
        lexemes.pop()
    if kind == "POLYGON":
        polygons = (many(ring),)
    elif kind == "MULTIPOLYGON":
        polygons = many(lambda: many(ring))
    else:
        raise ZoneError(f"invalid WKT zone: unknown type '{kind}'")
    if lexemes:
        raise ZoneError("invalid WKT zone: text after its end")
    return Zone(polygons)
