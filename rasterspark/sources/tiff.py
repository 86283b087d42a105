"""TIFF and BigTIFF: directories from a read-ahead window, tiles decoded to numpy arrays."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from rasterspark.sources.bytesource import ByteSource

READAHEAD = 32_768

# Fixed values of the format: struct codes by field type, and tag numbers.
_CODES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 277, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY = 2048, 3072


class TiffError(ValueError):
    """The file is not a tiled TIFF that this reader understands."""


class Far(Sequence):
    """The numbers of an array that lies beyond what was read of the directories; a page is fetched when a number of it is asked for."""

    def __init__(self, source: ByteSource, place: int, count: int, code: str, page: int = READAHEAD):
        self.source, self.place, self.count, self.code = source, place, count, code
        self.width = struct.calcsize(code)
        self.page, self.held = max(1, page // self.width), {}

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        k = i // self.page
        if k not in self.held:
            n = min(self.page, self.count - k * self.page)
            start = self.place + k * self.page * self.width
            try:
                data = self.source.read(start, start + n * self.width)
            except EOFError:
                data = b""
            if len(data) < n * self.width:
                raise TiffError("file ends inside a directory")
            self.held[k] = struct.unpack(f"{self.code[0]}{n}{self.code[1]}", data)
        return self.held[k][i % self.page]


class ReadAhead:
    """Bytes from the front of a source, in a window that doubles; later places are read as they are."""

    def __init__(self, source: ByteSource, size: int = READAHEAD):
        self.source, self.size, self.held, self.whole = source, size, b"", False

    def get(self, start: int, n: int) -> bytes:
        end = start + n
        if end > len(self.held) and not self.whole and end <= 64 * max(self.size, len(self.held)):
            want = max(self.size, len(self.held))
            while want < end:
                want *= 2
            more = self.source.read(len(self.held), want)
            self.whole = len(self.held) + len(more) < want
            self.held += more
        if end <= len(self.held):
            return self.held[start:end]
        if self.whole:
            raise TiffError("file ends inside a directory")
        data = self.source.read(start, end)
        if len(data) < n:
            raise TiffError("file ends inside a directory")
        return data


@dataclass(frozen=True)
class Directory:
    """Tags of one image."""

    order: str
    tags: dict[int, Sequence]

    def one(self, tag: int, default=None):
        got = self.tags.get(tag)
        return got[0] if got else default

    def text(self, tag: int) -> str | None:
        got = self.tags.get(tag)
        return b"".join(got).split(b"\0", 1)[0].decode("latin-1") if got else None


def read_directories(source: ByteSource) -> list[Directory]:
    """All directories of the main chain. Places and lengths of tiles that lie beyond the first window are read when a tile is."""
    ahead = ReadAhead(source)
    head = ahead.get(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise TiffError("not a TIFF file")
    magic = struct.unpack(order + "H", head[2:4])[0]
    if magic == 42:
        big, at = False, struct.unpack(order + "I", head[4:8])[0]
    elif magic == 43:
        big, at = True, struct.unpack(order + "Q", ahead.get(8, 8))[0]
    else:
        raise TiffError("not a TIFF file")
    count_code, offset_code, entry_size, count_size = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 2)
    inline = 8 if big else 4
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack(order + count_code, ahead.get(at, count_size))[0]
        raw = ahead.get(at + count_size, n * entry_size + inline)
        tags = {}
        for i in range(n):
            tag, kind, count, _ = struct.unpack_from(order + ("HHQQ" if big else "HHII"), raw, i * entry_size)
            code = _CODES.get(kind)
            if code is None:
                continue
            size = struct.calcsize(code) * count
            if size <= inline:
                data = raw[i * entry_size + entry_size - inline :][:size]
            else:
                place = struct.unpack_from(order + offset_code, raw, i * entry_size + entry_size - inline)[0]
                if tag in (TILE_OFFSETS, TILE_COUNTS) and not ahead.whole and place + size > len(ahead.held):
                    tags[tag] = Far(source, place, count, order + code)
                    continue
                data = ahead.get(place, size)
            tags[tag] = struct.unpack(f"{order}{count}{code}", data)
        out.append(Directory(order, tags))
        at = struct.unpack_from(order + offset_code, raw, n * entry_size)[0]
    return out


@dataclass(frozen=True)
class Tiling:
    """Tile grid and encoding of one image."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    bands: int
    planar: bool
    dtype: np.dtype
    bits: int
    compression: int
    predictor: int
    offsets: Sequence[int]
    counts: Sequence[int]

    @property
    def tiles_x(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def tiles_y(self) -> int:
        return -(-self.height // self.tile_height)

    def slots(self, x: int, y: int) -> list[int]:
        """Numbers of the tile's parts: one, or one for each band in planar layout."""
        first = y * self.tiles_x + x
        return [first + b * self.tiles_x * self.tiles_y for b in range(self.bands)] if self.planar else [first]

    def ranges(self, x: int, y: int) -> list[tuple[int, int]]:
        """Byte ranges of the tile's parts; a sparse part has an empty range."""
        return [(self.offsets[s], self.offsets[s] + self.counts[s]) if self.offsets[s] and self.counts[s] else (0, 0) for s in self.slots(x, y)]

    def decode(self, parts: list[bytes], fill: float | None = None) -> np.ndarray:
        """The tile as (bands, rows, cols); a sparse part is filled with nodata, or 0."""
        per = 1 if self.planar else self.bands
        planes = []
        for raw in parts:
            shape = (self.tile_height, self.tile_width, per)
            if not raw:
                whole = np.zeros(shape, self.dtype)
                if fill is not None and _fits(fill, self.dtype):
                    whole[...] = fill
            else:
                whole = self._samples(decompress(raw, self.compression, self._bytes(per)), per).reshape(shape)
            planes.append(np.moveaxis(whole, 2, 0))
        return np.concatenate(planes)

    def _bytes(self, per: int) -> int:
        if self.bits == 1:
            return self.tile_height * (-(-self.tile_width * per // 8))
        return self.tile_height * self.tile_width * per * self.dtype.itemsize

    def _samples(self, data: bytes, per: int) -> np.ndarray:
        need = self._bytes(per)
        if len(data) < need:
            raise TiffError(f"tile has {len(data)} bytes, expected {need}")
        rows, row_values = self.tile_height, self.tile_width * per
        if self.bits == 1:
            lines = np.frombuffer(data, np.uint8, need).reshape(rows, -1)
            return np.unpackbits(lines, axis=1)[:, :row_values].astype(bool)
        if self.predictor == 3:
            size = self.dtype.itemsize
            planes = np.frombuffer(data, np.uint8, need).reshape(rows, self.tile_width * size, per)
            planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, row_values)
            return np.ascontiguousarray(np.moveaxis(planes, 1, 2)).view(self.dtype.newbyteorder(">")).reshape(rows, row_values).astype(self.dtype.newbyteorder("="))
        values = np.frombuffer(data, self.dtype, need // self.dtype.itemsize)
        if self.predictor == 2:
            native = self.dtype.newbyteorder("=")
            unsigned = values.astype(native).view(f"u{native.itemsize}").reshape(rows, self.tile_width, per)
            return np.cumsum(unsigned, axis=1, dtype=unsigned.dtype).view(native)
        return values.astype(self.dtype.newbyteorder("="))


def _fits(value: float, dtype: np.dtype) -> bool:
    if dtype.kind == "f":
        return True
    if dtype.kind == "b" or not np.isfinite(value):
        return False
    info = np.iinfo(dtype)
    return info.min <= value <= info.max and float(value).is_integer()


def tiling(d: Directory) -> Tiling:
    """Grid and encoding of a directory; an image in strips is an error."""
    if TILE_WIDTH not in d.tags or TILE_HEIGHT not in d.tags or TILE_OFFSETS not in d.tags:
        raise TiffError("image is not tiled")
    bits = d.one(BITS, 1)
    if any(b != bits for b in d.tags.get(BITS, ())):
        raise TiffError("bands of different depth are not supported")
    form = d.one(SAMPLE_FORMAT, 1)
    if bits == 1:
        dtype = np.dtype(bool)
    else:
        kind = {1: "u", 2: "i", 3: "f", 4: "u"}.get(form)
        if kind is None or bits % 8 or bits > 64 or (kind == "f" and bits < 16):
            raise TiffError(f"sample format {form} with {bits} bits is not supported")
        dtype = np.dtype(f"{d.order}{kind}{bits // 8}")
    planar = d.one(PLANAR, 1)
    if planar not in (1, 2):
        raise TiffError(f"planar configuration {planar} is not supported")
    bands = d.one(SAMPLES, 1)
    return Tiling(d.one(WIDTH), d.one(HEIGHT), d.one(TILE_WIDTH), d.one(TILE_HEIGHT), bands, planar == 2 and bands > 1, dtype, bits, d.one(COMPRESSION, 1), d.one(PREDICTOR, 1), d.tags[TILE_OFFSETS], d.tags[TILE_COUNTS])


def decompress(raw: bytes, method: int, size: int) -> bytes:
    if method == 1:
        return raw
    if method in (8, 32946):
        return zlib.decompress(raw)
    if method == 50000:
        return pa.Codec("zstd").decompress(raw, decompressed_size=size, asbytes=True)
    if method == 5:
        return unlzw(raw)
    if method == 32773:
        return unpackbits(raw)
    raise TiffError(f"compression {method} is not supported")


def _lzw_widths() -> np.ndarray:
    """Bits of each code after a clear code: a code adds an entry, and widths grow one entry early, up to 12 bits."""
    entries = 258 + np.arange(4096)  # before the code's own entry, which the first code does not make
    return np.clip(np.ceil(np.log2(entries + 1)).astype(np.int64), 9, 12)


_WIDTHS = _lzw_widths()
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])
CLEAR, END, FIRST = 256, 257, 258  # fixed values of the format


def unlzw(raw: bytes) -> bytes:
    """LZW as TIFF has it: most significant bit first, codes widen one entry early.

    The places of all codes up to the next clear code are known beforehand. The n-th code after one makes an
    entry that lies in the output: what it wrote and the byte after it. So a code stands for a byte or for a run of
    earlier output, and the bytes are found by following all references at once.
    """
    data = np.frombuffer(raw + b"\0\0\0\0", np.uint8).astype(np.int64)
    out, at, total = [], 0, 8 * len(raw)
    began = False
    while at + 9 <= total:
        n = int(np.searchsorted(_STARTS[1:], total - at, "right"))
        first = at + _STARTS[:n]
        byte, width = first >> 3, _WIDTHS[:n]
        codes = ((data[byte] << 16 | data[byte + 1] << 8 | data[byte + 2]) >> (24 - (first & 7) - width)) & ((1 << width) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        end = int(stop[0]) if len(stop) else n
        if not began and (end or not len(stop)):
            raise TiffError("LZW data does not begin with a clear code")
        began = True
        out.append(_lzw_run(codes[:end]))
        if not len(stop) or codes[end] == END:
            break
        at += int(_STARTS[end + 1])
    return b"".join(out)


def _lzw_run(codes: np.ndarray) -> bytes:
    """The bytes of the codes between two clear codes."""
    n = len(codes)
    if not n:
        return b""
    entry = np.where(codes >= FIRST, codes - FIRST, -1)
    if (entry >= np.arange(n)).any():
        raise TiffError("LZW data is damaged")
    # how many bytes a code stands for: one more than the code that made its entry
    length, up = np.ones(n, np.int64), np.append(entry, -1)
    size = np.append((entry >= 0).astype(np.int64), 0)
    while (up >= 0).any():
        size, up = size + np.where(up >= 0, size[up], 0), np.where(up >= 0, up[up], -1)
    length += size[:n]
    begin = np.concatenate([[0], np.cumsum(length)])
    whose = np.repeat(np.arange(n), length)
    place = np.arange(begin[-1])
    source = np.where(entry[whose] >= 0, begin[entry[whose]] + place - begin[whose], place)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    return codes[whose[source]].astype(np.uint8).tobytes()


def unpackbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n = raw[at]
        at += 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)
