"""Caches of a Python worker: opened remote rasters and their decoded tiles.

Settings are read from the environment: COG_REMOTE_CACHE_TTL_S (60; 0 turns the raster cache off) and
COG_TILE_CACHE_MB (256 for each worker; 0 turns the tile cache off). Local files are not cached.
"""

from __future__ import annotations

import itertools
import os
import threading
import time
from collections import OrderedDict
from collections.abc import Callable

import numpy as np

OPEN_LIMIT = 8


class TileCache:
    """Decoded tiles, least recently used out first, at most `limit` bytes.

    Keys hold the number of the opened raster, so a raster that is opened again shares nothing with its past.
    """

    def __init__(self, limit: int):
        self.limit, self.held = limit, OrderedDict()
        self.hits = self.misses = self.evictions = self.bytes = 0
        self.lock = threading.Lock()
        self.coming: dict[tuple, tuple[threading.Event, list]] = {}

    def get(self, key: tuple) -> np.ndarray | None:
        with self.lock:
            tile = self.held.get(key)
            if tile is None:
                self.misses += 1
            else:
                self.hits += 1
                self.held.move_to_end(key)
            return tile

    def put(self, key: tuple, tile: np.ndarray) -> None:
        with self.lock:
            if tile.nbytes > self.limit or key in self.held:
                return
            self.held[key] = tile
            self.bytes += tile.nbytes
            while self.bytes > self.limit:
                self.bytes -= self.held.popitem(last=False)[1].nbytes
                self.evictions += 1

    def claim(self, key: tuple) -> tuple[np.ndarray | None, bool]:
        """The tile; or nothing, and whether the caller is the first to miss it, who must `settle` it."""
        tile = self.get(key)
        if tile is not None:
            return tile, False
        with self.lock:
            first = key not in self.coming
            if first:
                self.coming[key] = (threading.Event(), [])
            return None, first

    def settle(self, key: tuple, tile: np.ndarray | None) -> None:
        """Give a claimed tile, or None if it could not be had, to the cache and to those that wait."""
        if tile is not None:
            self.put(key, tile)
        with self.lock:
            event, box = self.coming.pop(key)
            box.append(tile)
        event.set()

    def wait(self, key: tuple) -> np.ndarray | None:
        """The tile that another thread has claimed, or None if that thread has failed or was done before."""
        with self.lock:
            event, box = self.coming.get(key, (None, None))
            if event is None:
                return self.held.get(key)
        event.wait()
        return box[0]

    def stats(self) -> dict[str, int]:
        return {"hits": self.hits, "misses": self.misses, "evictions": self.evictions, "bytes": self.bytes, "max_bytes": self.limit}


class OpenCache:
    """Opened rasters by path for `ttl` seconds, at most OPEN_LIMIT, the oldest out first."""

    def __init__(self, ttl: float, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.held = ttl, clock, OrderedDict()
        self.lock = threading.Lock()

    def get(self, path: str, make: Callable[[], object]) -> object:
        if self.ttl <= 0:
            return make()
        with self.lock:
            found = self.held.get(path)
            if found and self.clock() - found[0] < self.ttl:
                return found[1]
        made = make()
        with self.lock:
            self.held.pop(path, None)
            self.held[path] = (self.clock(), made)
            while len(self.held) > OPEN_LIMIT:
                self.held.popitem(last=False)
        return made


def _setting(name: str, default: float) -> float:
    try:
        return float(os.environ.get(name, default))
    except ValueError:
        return default


reader_numbers = itertools.count(1)
tiles = TileCache(int(_setting("COG_TILE_CACHE_MB", 256) * 1_000_000))
rasters = OpenCache(_setting("COG_REMOTE_CACHE_TTL_S", 60))
