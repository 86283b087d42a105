"""Vectorised helpers on UTF-8 text columns: flat bytes, words, hashes, ragged gathers.

Everything works on whole texts. A batch is walked in slices of about `SLICE` bytes to bound
memory; a longer text makes a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 2_000_000

SHORT_BLOCKS = 8  # 8-byte blocks of a span that are hashed for all spans at once

def as_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column as uint8, with its n + 1 offsets; null is empty."""
    arr = as_array(column)
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of this process


def release() -> None:
    """Give memory that a finished task or batch no longer uses back to the system; Python workers live on."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_only: dict = {}


def only(key: tuple, make: Callable):
    """What `make` gives, kept for `key` until this worker asks for another: a worker holds one tokenizer or model at a time."""
    if key not in _only:
        _only.clear()
        release()
        _only[key] = make()
    return _only[key]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts have about `size` bytes together, at least one row each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each span; it depends on the bytes only, not on the place.

    Each block of 8 bytes is mixed in by a bijection, so unequal spans of one length up to 8 never collide, and there is no
    algebra by which longer ones do, as there is for polynomials. Spans of more than SHORT_BLOCKS blocks go through XXH3.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from every place on
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
    live, first = np.flatnonzero(lengths <= 8 * SHORT_BLOCKS), 0
    while len(live := live[lengths[live] > first]):
        block = at[starts[live] + first]
        rest = np.minimum(lengths[live] - first, 8).astype(np.uint64)
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest)
        out[live] = mix((out[live] ^ block) + np.uint64(0xA0761D6478BD642F))
        first += 8
    for i in np.flatnonzero(lengths > 8 * SHORT_BLOCKS).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs outside [\\x20\\x09-\\x0D], and how many each text has."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    starts = np.flatnonzero(solid & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    ends = np.flatnonzero(solid & (after | first[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, with repeats, and how many each text has.

    A text of fewer words gives one shingle, its whole sequence; a text without words none.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    rows = np.repeat(np.arange(len(counts)), out)
    at = np.arange(out.sum()) - np.repeat(np.cumsum(out) - out, out) + begins[rows]
    acc = np.full(len(at), np.uint64(size), np.uint64)
    last = ends[rows]
    for k in range(size):
        inside = at + k < last
        step = np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))], np.uint64(0x1234567)) if len(hashes) else acc
        acc = mix(acc * np.uint64(0xD1342543DE82EF95) + step + np.uint64(k + 1))
    return acc, out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the runs (start, length), one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    steps = np.ones(total, np.int64)
    steps[0] = starts[0]
    heads = np.cumsum(lengths)[:-1]
    steps[heads] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(steps)


def binary_array(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Arrow array (of large binary values, or of another large kind) over runs that tile `data`."""
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
