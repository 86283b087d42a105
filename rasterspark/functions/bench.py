"""The byte-source workload: open, scattered points, central window; counts, bytes and checksums."""

from __future__ import annotations

import time

from rasterspark.functions.engine import Raster
from rasterspark.sources.bytesource import CountingSource, open_source

# The seed and, below, the shifts of the workload's points, by which its checksums can be compared.
SEED = 0x9E3779B97F4A7C15
POINTS = 64
_MASK = (1 << 64) - 1


def scattered(n: int = POINTS, seed: int = SEED) -> list[tuple[float, float]]:
    """Pairs in [0, 1) from a xorshift generator, the same on every run."""
    state, out = seed, []
    for _ in range(2 * n):
        for shift in (13, -7, 17):
            state ^= (state << shift) & _MASK if shift > 0 else state >> -shift
        out.append((state >> 11) / (1 << 53))
    return list(zip(out[::2], out[1::2], strict=True))


def workload(path: str, io: str = "auto") -> list[tuple[str, float]]:
    """(metric, value): milliseconds, fetches and bytes of each phase, and sums of the pixels read."""
    try:
        return _workload(path, io)
    except (OSError, ValueError, EOFError) as e:
        raise ValueError(f"cog_io_bench: {e}" if path in str(e) else f"cog_io_bench: '{path}': {e}") from e


def _workload(path: str, io: str) -> list[tuple[str, float]]:
    began = time.perf_counter()
    source = CountingSource(open_source(path, io))
    rows = [("open_ms", 1000 * (time.perf_counter() - began))]

    def phase(name: str, run):
        start, fetches, size = time.perf_counter(), source.fetches, source.bytes
        out = run()
        rows.extend([(f"{name}_ms", 1000 * (time.perf_counter() - start)), (f"{name}_fetches", float(source.fetches - fetches)), (f"{name}_bytes", float(source.bytes - size))])
        return out

    raster = phase("meta", lambda: Raster(source))
    g, top = raster.meta.need_georef(), raster.top
    xmax, ymin = g.origin_x + top.width * g.pixel_x, g.origin_y - top.height * g.pixel_y
    wide, high = xmax - g.origin_x, g.origin_y - ymin
    places = [(g.origin_x + a * wide, ymin + b * high) for a, b in scattered()]
    values, known = phase("points", lambda: raster.pixels([p[0] for p in places], [p[1] for p in places], 1))
    rows.append(("points_checksum", float(values[known].sum())))
    box = [g.origin_x + wide / 4, ymin + high / 4, xmax - wide / 4, g.origin_y - high / 4]
    (stats,) = phase("window", lambda: raster.zonal([box], 1))
    rows.append(("window_checksum", stats.sum))
    return rows
