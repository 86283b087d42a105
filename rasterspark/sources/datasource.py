"""Spark data sources: `cog` lists tiles with pushed-down filters, `stac` reads documents and searches."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from rasterspark.functions import engine
from rasterspark.functions.model import Meta
from rasterspark.functions.types import arrow_schema
from rasterspark.sources import stac

CHUNK = 65_536  # tiles of a partition
SLOTS = 4096  # partitions of a load of many files
SIDES = ("xmin", "ymin", "xmax", "ymax")
TILES = "path string, id bigint, level int, tile_x int, tile_y int, cols int, rows int, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, crs string"


@dataclass
class TileRows(InputPartition):
    """Rows of tiles first..last of one level of a file, or whole files (level -1)."""

    paths: list[str]
    level: int = -1
    first: int = 0
    last: int = 0


def paths_of(options) -> list[str]:
    """The paths of a source: option `paths` (a JSON list), or `path`."""
    given = json.loads(options["paths"]) if options.get("paths") else [options.get("path")]
    if not given or not all(isinstance(p, str) for p in given):
        raise ValueError("a path is needed: load(path) or option 'paths' with a JSON list")
    return given


class CogSource(DataSource):
    """Tiles of one raster or of many, with the path as a column."""

    @classmethod
    def name(cls) -> str:
        return "cog"

    def schema(self) -> str:
        return TILES

    def reader(self, schema) -> "CogReader":
        return CogReader(paths_of(self.options))


class CogReader(DataSourceReader):
    """Plans chunks of tile rows. Filters on level, path and the box's sides bound what is listed."""

    def __init__(self, paths: list[str]):
        self.paths, self.levels = paths, None
        self.box = {"xmin": float("inf"), "ymin": float("inf"), "xmax": float("-inf"), "ymax": float("-inf")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Ranges only narrow the listing; every filter is applied again after it."""
        for f in filters:
            name = tuple(getattr(f, "attribute", ()))
            if name == ("level",) and isinstance(f, EqualTo):
                self.levels = {f.value} if self.levels is None else self.levels & {f.value}
            elif name == ("path",) and isinstance(f, EqualTo):
                self.paths = [p for p in self.paths if p == f.value]
            elif len(name) == 2 and name[0] == "bbox" and name[1] in self.box:
                side = name[1]
                if side in ("xmin", "ymin") and isinstance(f, LessThan | LessThanOrEqual):
                    self.box[side] = min(self.box[side], float(f.value))
                elif side in ("xmax", "ymax") and isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.box[side] = max(self.box[side], float(f.value))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Chunks of one file's tiles; several files are opened by their tasks, as many as SLOTS tasks have them, and not here."""
        if len(self.paths) != 1:
            step = max(1, -(-len(self.paths) // SLOTS))
            return [TileRows(self.paths[k : k + step]) for k in range(0, len(self.paths), step)] or [TileRows([])]
        out = []
        for number, level in enumerate(engine.Opener()(self.paths[0]).meta.levels):
            if self.levels is None or number in self.levels:
                step = max(1, CHUNK // level.tiles_x)
                out += [TileRows(self.paths, number, y, min(y + step, level.tiles_y)) for y in range(0, level.tiles_y, step)]
        return out or [TileRows([])]

    def read(self, partition: TileRows) -> Iterator[pa.RecordBatch]:
        opener = engine.Opener()
        opener.ahead(partition.paths)
        rows, schema = [], arrow_schema(TILES)
        for row in (row for path in partition.paths for row in self._rows(path, opener(path).meta, partition)):
            rows.append(row)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def _rows(self, path: str, meta: Meta, partition: TileRows) -> Iterator[dict]:
        wanted = None
        if meta.georef and any(map(math.isfinite, self.box.values())):
            # what touches the box [least xmax, least ymax, greatest xmin, greatest ymin] of the filters
            wanted = [self.box["xmax"], self.box["ymax"], self.box["xmin"], self.box["ymin"]]
        spans = [(partition.level, partition.first, partition.last)] if partition.level >= 0 else [(k, 0, t.tiles_y) for k, t in enumerate(meta.levels) if self.levels is None or k in self.levels]
        for number, first, last in spans:
            for key, level, x, y, cols, rows, box, crs in meta.level_tiles(number, first, last, wanted):
                yield {"path": path, "id": key, "level": level, "tile_x": x, "tile_y": y, "cols": cols, "rows": rows, "bbox": box and dict(zip(SIDES, box, strict=True)), "crs": crs}


class StacSource(DataSource):
    """Documents by path, a task each; or, with option `search`, a search API read page by page."""

    @classmethod
    def name(cls) -> str:
        return "stac"

    def schema(self) -> str:
        return stac.SCHEMA

    def reader(self, schema) -> "StacReader":
        return StacReader(dict(self.options))


class StacReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        if self.options.get("search"):
            return [InputPartition(self.options["search"])]  # pages follow each other
        return [InputPartition(p) for p in paths_of(self.options)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not self.options.get("search"):
            yield from stac.read_document(partition.value)
            return
        load = lambda key: json.loads(self.options[key]) if self.options.get(key) else None
        yield from stac.search(partition.value, load("collections"), load("bbox"), self.options.get("datetime"), load("page_size"), load("max_rows"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CogSource)
    spark.dataSource.register(StacSource)
