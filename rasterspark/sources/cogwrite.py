"""A small writer of tiled TIFF files, for fixtures and for rasters made from tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from rasterspark.sources import tiff

_METHODS = {"none": 1, "deflate": 8, "zstd": 50000, "lzw": 5}
_TYPES = {"H": 3, "I": 4, "d": 12, "c": 2, "Q": 16}


def lzw(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0
    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = (bits << width) | code, have + width
        while have >= 8:
            out.append((bits >> (have - 8)) & 255)
            have -= 8
            bits &= (1 << have) - 1

    put(256)
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        word = longer[-1:]
        if len(table) + 2 >= 4094:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif len(table) + 2 >= 1 << width:
            width += 1
    if word:
        put(table[word])
    put(257)
    if have:
        out.append((bits << (8 - have)) & 255)
    return bytes(out)


def _compress(data: bytes, method: str) -> bytes:
    if method == "deflate":
        return zlib.compress(data)
    if method == "zstd":
        return pa.Codec("zstd").compress(data, asbytes=True)
    return lzw(data) if method == "lzw" else data


def _encode(tile: np.ndarray, order: str, predictor: int) -> bytes:
    """tile: (rows, cols, samples)."""
    if tile.dtype == bool:
        return np.packbits(tile.reshape(len(tile), -1), axis=1).tobytes()
    if predictor == 2:
        raw = tile.view(f"u{tile.itemsize}")
        tile = np.concatenate([raw[:, :1], np.diff(raw, axis=1)], axis=1).view(tile.dtype)
    if predictor == 3:
        rows, cols, samples = tile.shape
        planes = np.moveaxis(tile.astype(tile.dtype.newbyteorder(">")).reshape(rows, cols * samples).view(np.uint8).reshape(rows, cols * samples, tile.itemsize), 2, 1)
        flat = np.ascontiguousarray(planes).reshape(rows, cols * tile.itemsize, samples)
        return np.concatenate([flat[:, :1], np.diff(flat, axis=1)], axis=1).astype(np.uint8).tobytes()
    return np.ascontiguousarray(tile.astype(tile.dtype.newbyteorder(order))).tobytes()


def write_cog(
    bands: np.ndarray, *, tile: int = 256, overviews: Sequence[int] = (), origin: tuple[float, float] | None = (0.0, 0.0), pixel: tuple[float, float] = (10.0, 10.0), epsg: int | None = 32652, geographic: bool = False,
    nodata: str | None = None, metadata: str | None = None, compression: str = "none", predictor: int = 1, planar: bool = False, big: bool = False, order: str = "<", sparse: bool = False,
) -> bytes:
    """The file with bands (bands, rows, cols) as its first image and nearest overviews by the given factors.

    All directories come first, then the places and lengths of tiles, then the tiles. With `sparse`, tiles of zeros are left out.
    """
    images = [bands, *(bands[:, ::f, ::f] for f in overviews)]
    parts: list[list[bytes]] = []
    for image in images:
        n, h, w = image.shape
        rows, cols = -(-h // tile), -(-w // tile)
        padded = np.zeros((n, rows * tile, cols * tile), image.dtype)
        padded[:, :h, :w] = image
        tiles = []
        for plane in [padded[k : k + 1] for k in range(n)] if planar else [padded]:
            for y in range(rows):
                for x in range(cols):
                    cell = np.moveaxis(plane[:, y * tile : (y + 1) * tile, x * tile : (x + 1) * tile], 0, 2)
                    tiles.append(b"" if sparse and not cell.any() else _compress(_encode(cell, order, predictor), compression))
        parts.append(tiles)
    counts = [[len(x) for x in tiles] for tiles in parts]
    head = directories([x.shape for x in images], bands.dtype, counts, tile=tile, origin=origin, pixel=pixel, epsg=epsg, geographic=geographic, nodata=nodata, metadata=metadata, compression=compression, predictor=predictor, planar=planar, big=big, order=order)
    return head + b"".join(x for tiles in parts for x in tiles)


def tiles_of(bands: np.ndarray, tile: int, compression: str) -> list[bytes]:
    """The encoded tiles of (bands, rows, cols), row by row; what is beyond the last row or column is 0."""
    n, h, w = bands.shape
    rows, cols = -(-h // tile), -(-w // tile)
    padded = np.zeros((n, rows * tile, cols * tile), bands.dtype)
    padded[:, :h, :w] = bands
    cells = (padded[:, y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(rows) for x in range(cols))
    return [_compress(_encode(np.moveaxis(c, 0, 2), "<", 1), compression) for c in cells]


def directories(
    shapes: Sequence[tuple[int, int, int]], dtype: np.dtype, counts: Sequence[Sequence[int]], *, tile: int = 256, origin: tuple[float, float] | None = (0.0, 0.0), pixel: tuple[float, float] = (10.0, 10.0), epsg: int | None = 32652,
    geographic: bool = False, nodata: str | None = None, metadata: str | None = None, compression: str = "none", predictor: int = 1, planar: bool = False, big: bool = False, order: str = "<", stored: Sequence[tuple[int, int]] | None = None,
) -> bytes:
    """Head of a file of images of (bands, rows, cols) whose encoded tiles have these lengths, 0 for one that is left out.

    The tiles follow the head, image after image, or in the order of `stored`, which lists all (image, tile).
    """
    places = [[0] * len(c) for c in counts]
    stored = stored or [(k, t) for k, c in enumerate(counts) for t in range(len(c))]
    for _ in range(2):  # lengths do not depend on the places, so the second pass is final
        head = _directories(shapes, dtype, counts, places, tile, origin, pixel, epsg, geographic, nodata, metadata, compression, predictor, planar, big, order)
        at = len(head)
        for k, t in stored:
            places[k][t] = at if counts[k][t] else 0
            at += counts[k][t]
    return head


def _directories(shapes, dtype, counts, places, tile, origin, pixel, epsg, geographic, nodata, metadata, compression, predictor, planar, big, order) -> bytes:
    offset, inline = ("Q", 8) if big else ("I", 4)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8)))
    images = []
    for k, (n, h, w) in enumerate(shapes):
        bits = 1 if dtype == bool else dtype.itemsize * 8
        tags: list[tuple[int, str, tuple]] = [
            (tiff.WIDTH, "I", (w,)), (tiff.HEIGHT, "I", (h,)), (tiff.BITS, "H", (bits,) * n), (tiff.COMPRESSION, "H", (_METHODS[compression],)), (tiff.PHOTOMETRIC, "H", (1,)), (tiff.SAMPLES, "H", (n,)),
            (tiff.PLANAR, "H", (2 if planar else 1,)), (tiff.PREDICTOR, "H", (predictor,)), (tiff.TILE_WIDTH, "I", (tile,)), (tiff.TILE_HEIGHT, "I", (tile,)), (tiff.TILE_OFFSETS, offset, tuple(places[k])),
            (tiff.TILE_COUNTS, offset, tuple(counts[k])), (tiff.SAMPLE_FORMAT, "H", ({"u": 1, "b": 1, "i": 2, "f": 3}[dtype.kind],) * n),
        ]
        if k == 0 and origin is not None:
            tags += [(tiff.PIXEL_SCALE, "d", (*pixel, 0.0)), (tiff.TIEPOINT, "d", (0.0, 0.0, 0.0, *origin, 0.0))]
            if epsg is not None:
                tags.append((tiff.GEO_KEYS, "H", (1, 1, 0, 1, tiff.GEOGRAPHIC_KEY if geographic else tiff.PROJECTED_KEY, 0, 1, epsg)))
        if k == 0:
            tags += [(tag, "c", tuple(bytes([b]) for b in text.encode("latin-1") + b"\0")) for tag, text in ((tiff.METADATA, metadata), (tiff.NODATA, nodata)) if text is not None]
        images.append([(tag, code, len(values), struct.pack(f"{order}{len(values)}{code}", *values)) for tag, code, values in sorted(tags)])
    # the arrays of places and lengths lie behind all directories, so that what opens a file is at its front
    far = (tiff.TILE_OFFSETS, tiff.TILE_COUNTS)
    room = lambda data: len(data) + -len(data) % 8 if len(data) > inline else 0
    sizes = [(8 if big else 2) + len(tags) * (20 if big else 12) + inline for tags in images]
    behind = len(out) + sum(sizes) + sum(room(data) for tags in images for tag, _, _, data in tags if tag not in far)
    arrays = bytearray()
    for k, (tags, size) in enumerate(zip(images, sizes, strict=True)):
        entries, extra, base = bytearray(), bytearray(), len(out) + size
        for tag, code, count, data in tags:
            entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, _TYPES[code], count)
            if len(data) <= inline:
                entries += data.ljust(inline, b"\0")
                continue
            start, kept = (behind, arrays) if tag in far else (base, extra)
            entries += struct.pack(order + offset, start + len(kept))
            kept += data + b"\0" * (-len(data) % 8)
        following = base + len(extra) if k + 1 < len(shapes) else 0
        out += struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + struct.pack(order + offset, following) + extra
    return bytes(out + arrays)
