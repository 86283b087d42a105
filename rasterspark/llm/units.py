"""Encoding by distinct units of text.

A byte-level BPE whose pre-tokens are those of public_tokenizers.PATTERN never joins bytes over
two kinds of place, so a text may be cut there and each piece encoded alone:

* before a space that a non-space follows (the space always opens the next pre-token);
* around a newline with non-spaces on both sides (it is a pre-token by itself);
* between an ASCII letter and ASCII punctuation, in either order (runs of letters and of marks are
  separate pre-tokens), but not after an apostrophe, which may open a contraction.

Cuts are made only where single bytes prove the place; elsewhere a unit just gets longer. Equal units
are encoded once per batch, and a bounded store keeps the ids of those that come again. Units are
compared by their characters, never by hashes alone. A cut never splits a character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rasterspark.llm.textbytes import binary_array, ragged

# Bytes that surely begin a character outside \s: ASCII graphics, and UTF-8 lead bytes but those of
# characters that may be white space (C2, E1, E2, E3).
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xF5] = True
_SOLID[[0xE1, 0xE2, 0xE3]] = False
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _PLAIN & ~_LETTER
_MARK[0x30:0x3A] = False
_OPENER = _MARK.copy()
_OPENER[0x27] = False


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every unit, ascending; the first byte of each text starts one."""
    n = len(data)
    starts = np.zeros(n + 1, bool)
    starts[offsets] = True
    if n > 1:
        edge = starts.copy()
        follows = np.zeros(n, bool)
        follows[:-1] = _SOLID[data[1:]] & ~edge[1:n]
        starts[:n] |= (data == 0x20) & follows
        line = (data == 0x0A) & follows & ~edge[:n]
        line[1:] &= _PLAIN[data[:-1]]
        line[0] = False
        starts[:n] |= line
        starts[1 : n + 1] |= line
        letter = _LETTER[data]
        starts[1:n] |= (letter[:-1] & _MARK[data[1:]]) | (_OPENER[data[:-1]] & letter[1:])
    return np.flatnonzero(starts[:n])


def occurrences(data: np.ndarray, offsets: np.ndarray, strings: re.Pattern[bytes]) -> np.ndarray:
    """[start, end) of every match inside one text, in order."""
    if strings.search(data) is None:
        return np.empty((0, 2), np.int64)
    found = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found += [(a + m.start(), a + m.end()) for m in strings.finditer(data[a:b])]
    return np.array(found, np.int64).reshape(-1, 2)


class UnitStore:
    """Ids of units seen before, at most `limit` of them, else only those of the last batch, which are the common ones.

    Keys are one Arrow array (a few bytes a unit; a dictionary of strings took ten times as much at the same speed).

    Occurrences of `whole` strings (the longest at a place) are units of their own, and what is between them
    is cut like texts of their own.
    """

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], limit: int = 300_000, whole: Sequence[bytes] = ()):
        self.encode, self.limit = encode, limit
        self.whole = re.compile(b"|".join(re.escape(x) for x in sorted(whole, key=len, reverse=True))) if whole else None
        self._set(pa.array([], pa.large_string()), np.empty(0, np.uint32), np.zeros(1, np.int64))

    def _set(self, keys: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.keys, self.ids, self.offsets = keys, ids, offsets

    def _places(self, wanted: pa.Array) -> np.ndarray:
        """Where each wanted unit stands in the store, after encoding those not in it."""
        at = pc.index_in(wanted, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            fresh = wanted.take(pa.array(missing))
            made = self.encode(fresh.to_pylist())
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.fromiter(chain.from_iterable(made), np.uint32, int(lengths.sum()))
            at[missing] = len(self.keys) + np.arange(len(missing))
            self._set(pa.concat_arrays([self.keys, fresh]), np.concatenate([self.ids, flat]), np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)]))
        if len(self.keys) > self.limit:
            spans = self.offsets[at + 1] - self.offsets[at]
            self._set(wanted, self.ids[ragged(self.offsets[at], spans)], np.concatenate([[0], np.cumsum(spans)]))
            at = np.arange(len(wanted))
        return at

    def encode_texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 offsets of the texts in them."""
        ids, begin, lengths, ends, starts = self._units(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
        return ids[ragged(begin, lengths)], ends[np.searchsorted(starts, offsets)]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of each text; the first id of every unit, one text after the other; and the number of units of each text."""
        ids, begin, _, ends, starts = self._units(data, offsets)
        if not len(starts):
            none = np.zeros(len(offsets) - 1, np.int64)
            return none, np.empty(0, np.uint32), none
        at = np.searchsorted(starts, offsets)
        return np.diff(ends[at]), ids[begin], np.diff(at)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """The arena, where each unit's ids begin in it and how many they are, their running sum, and the units' starts."""
        if not len(data):
            return (*(np.empty(0, np.int64),) * 3, np.zeros(1, np.int64), np.empty(0, np.int64))
        kept = occurrences(data, offsets, self.whole) if self.whole else ()
        if len(kept):
            starts = cut(data, np.unique(np.concatenate([offsets, kept.ravel()])))
            at = np.searchsorted(kept[:, 0], starts, "left") - 1  # the last occurrence that begins before
            starts = starts[(at < 0) | (starts >= kept[at, 1])]
        else:
            starts = cut(data, offsets)
        coded = binary_array(data, np.append(starts, len(data)), pa.large_string()).dictionary_encode()
        places = self._places(coded.dictionary)
        own = places[coded.indices.to_numpy()]
        begin = self.offsets[own]
        lengths = self.offsets[own + 1] - begin
        return self.ids, begin, lengths, np.concatenate([[0], np.cumsum(lengths)]), starts
