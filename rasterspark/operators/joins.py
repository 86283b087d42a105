"""Joins on order instead of equality: the last row before a time, and values inside intervals.

Both cut the ordered axis into buckets of `width`, so that a key with a large part of all rows spreads over as many tasks as
it has buckets; what crosses a bucket's edge is carried by one row for each key and bucket, or by a copy of an interval.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql.types import TimestampNTZType, TimestampType


def _number(df: DataFrame, name: str) -> Column:
    """The ordered column as a number: seconds of a timestamp, or the value itself."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, TimestampType | TimestampNTZType):
        return F.unix_micros(column.cast("timestamp")) / 1e6
    return column.cast("double")


def as_of_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], at: str, take: Sequence[str], width: float) -> DataFrame:
    """Each row of `left` with the columns `take` of the last row of `right` that has its key and is not later.

    Both sides have the columns `by` and `at`. Without such a row, or with a null key or time, `take` is null. Of rows of `right` at
    one time that of the largest `take` counts; rows without key or time do not.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    named = lambda df: [F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)]
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    found = F.struct(*[F.col(f"`{c}`").alias(c) for c in take])
    bucket = lambda df: F.floor(_number(df, at) / width).alias("__b")
    known = right.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*by, at)))
    ours = left.select(*named(left), bucket(left), F.col(f"`{at}`").alias("__t"), F.lit(1).alias("__side"), whole.alias("__row"), F.lit(None).cast(known.select(found).schema[0].dataType).alias("__v"))
    theirs = known.select(*named(known), bucket(known), F.col(f"`{at}`").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(ours.schema["__row"].dataType).alias("__row"), found.alias("__v"))
    both = ours.unionByName(theirs)
    before = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("__v", F.last("__v", ignorenulls=True).over(before)).where("__side = 1")
    last = both.groupBy(*keys, "__b").agg(F.max(F.when(F.col("__side") == 0, F.struct("__t", "__v"))).alias("__m"))
    earlier = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("__m", F.last("__m", ignorenulls=True).over(earlier)).where("__m IS NOT NULL").select(*keys, "__b", F.col("__m.__v").alias("__c"))
    out = inside.join(carry, [*keys, "__b"], "left").withColumn("__v", F.coalesce("__v", "__c"))
    return out.select("__row.*", *[F.col("__v")[c].alias(c) for c in take])


def interval_join(points: DataFrame, intervals: DataFrame, *, at: str, low: str, high: str, width: float) -> DataFrame:
    """All pairs of a point and an interval with low <= at <= high; column names must differ.

    An interval is copied to the buckets that it touches, so `width` should be about the length of most. Null bounds and points match nothing.
    """
    edge = lambda name: F.floor(_number(intervals, name) / width)
    touched = F.when(edge(low) <= edge(high), F.sequence(edge(low), edge(high)))
    spread = intervals.withColumn("__b", F.explode(touched))
    placed = points.withColumn("__p", F.floor(_number(points, at) / width))
    met = placed.join(spread, F.col("__p") == F.col("__b"))
    return met.where((F.col(f"`{at}`") >= F.col(f"`{low}`")) & (F.col(f"`{at}`") <= F.col(f"`{high}`"))).drop("__b", "__p")
