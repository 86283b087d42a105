"""Tile keys, coordinates and windows as column expressions over metadata columns."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column


def pack_key(level: Column, x: Column, y: Column) -> Column:
    """level << 48 | x << 24 | y; null if x or y needs more than 24 bits."""
    key = F.shiftleft(level.cast("long"), 48).bitwiseOR(F.shiftleft(x.cast("long"), 24)).bitwiseOR(y.cast("long"))
    return F.when((x >= 0) & (x < 1 << 24) & (y >= 0) & (y < 1 << 24), key)


def unpack_key(key: Column) -> tuple[Column, Column, Column]:
    low = F.lit((1 << 24) - 1)
    return F.shiftright(key, 48).cast("int"), F.shiftright(key, 24).bitwiseAND(low).cast("int"), key.bitwiseAND(low).cast("int")


def pixel_of(at: Column, origin: Column, size: Column, sign: int) -> Column:
    """0-based column (sign 1) or row (sign -1) of a coordinate, unbounded."""
    return F.floor((at - origin) * sign / size)


def first_centre(low: Column, origin: Column, size: Column, sign: int) -> Column:
    """First column or row whose centre is not before a side of a closed box, at least 0."""
    return F.greatest(F.ceil((low - origin) * sign / size - 0.5), F.lit(0).cast("long"))


def last_centre(high: Column, origin: Column, size: Column, sign: int, n: Column) -> Column:
    """Last column or row whose centre is not beyond a side, at most n - 1."""
    return F.least(F.floor((high - origin) * sign / size - 0.5), (n - 1).cast("long"))


def steps(first: Column, last: Column) -> Column:
    """The whole numbers first..last, none if the range is empty."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
