"""Shards of bounded size by extendible hashing, with DataFrame functions only.

Every row has a hash of `BITS` bits. The directory is indexed by a prefix of the hash: a bucket of local depth d
holds the rows that share d bits. Starting from one bucket, only a bucket over the byte limit splits, on the
next bit, until every bucket fits. Sums are taken over cells of a deeper prefix first, so the tree
is found from few rows per shard; cells that are still too large are refined in a further round.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from rasterspark.session import Scratch

BITS = 60
STEP = 12  # bits added by a round
SPARE = 4  # bits of the first round beyond log2(total / limit)


def hash_bits(key: str) -> Column:
    """The first BITS bits of the MD5 of the key as text (a null key as empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(depth) -> Column:
    return F.expr(f"shiftright(h, {BITS} - {depth})")


def directory(scratch: Scratch, rows: DataFrame, limit: int) -> list[tuple[DataFrame, int]]:
    """Rounds of (cell, local_depth, shard, shard_bytes), each with the number of bits of its cells.

    rows: (h, n_bytes). A cell's leaf is the shallowest bucket above it that fits; a bucket of one hash
    value cannot split and is a leaf of any size.
    """
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, -(-total // limit)).bit_length() + SPARE)
    low, rounds = 0, []
    while True:
        cells = scratch.table(rows.groupBy(_prefix(depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.min("h").alias("x"), F.max("h").alias("y")), f"cells-{depth}")
        above = cells.select("*", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn("shard", F.expr(f"shiftright(cell, {depth} - d)"))
        buckets = scratch.table(above.groupBy("d", "shard").agg(F.sum("b").alias("shard_bytes"), F.min("x").alias("x"), F.max("y").alias("y")).where((F.col("shard_bytes") <= limit) | (F.col("x") == F.col("y"))).select("d", "shard", "shard_bytes"), f"buckets-{depth}")
        fitting = above.select("cell", "d", "shard").join(buckets.hint("merge"), ["d", "shard"])  # grows with the shards: no broadcast
        leaf = fitting.groupBy("cell").agg(F.min("d").alias("local_depth"), F.min_by("shard", "d").alias("shard"), F.min_by("shard_bytes", "d").alias("shard_bytes"))
        leaf = scratch.table(leaf, f"leaves-{depth}")
        rounds.append((leaf, depth))
        open_cells = cells.select("cell").join(leaf.hint("merge"), "cell", "left_anti")
        if depth == BITS or open_cells.isEmpty():
            return rounds
        rows = scratch.table(rows.withColumn("cell", _prefix(depth)).join(open_cells.hint("merge"), "cell", "left_semi").drop("cell"), f"open-{depth}")
        low, depth = depth + 1, min(BITS, depth + STEP)


def _placed(scratch: Scratch, rows: DataFrame, limit: int) -> DataFrame:
    """`rows`, which have h and n_bytes, with local_depth, shard and shard_bytes."""
    out, rest = None, rows
    for leaf, depth in directory(scratch, rows.select("h", "n_bytes"), limit):
        keyed = rest.withColumn("cell", _prefix(depth))
        done = keyed.join(leaf.hint("merge"), "cell").withColumn("local_depth", F.col("local_depth").cast("int")).drop("cell").select(*rows.columns, "local_depth", "shard", "shard_bytes")
        out = done if out is None else out.unionByName(done)
        rest = keyed.join(leaf.hint("merge"), "cell", "left_anti").drop("cell")
    return out


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """Placed rows, those of leaves over the limit placed anew by bits that tell the rows of one id apart.

    Below a leaf's depth the bits of one id decide nothing, so they are replaced by a hash of text and place; the
    leaf then splits like any other. A leaf of one row stays.
    """
    spark = rows.sparkSession
    over = rows.where(F.col("shard_bytes") > limit)
    many = over.groupBy("local_depth", "shard").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    scratch = Scratch(spark, "sharding-ids")
    hot = over.join(many.hint("merge"), ["local_depth", "shard"], "left_semi")
    own = F.shiftrightunsigned(F.xxhash64("digest", "place"), 64 - BITS)
    hot = hot.withColumn("own", own).withColumn("h", F.expr(f"shiftleft(shard, {BITS} - local_depth) | shiftright(own, local_depth)"))
    hot = scratch.table(hot.drop("own", "local_depth", "shard", "shard_bytes"), "hot")
    if hot.isEmpty():
        return rows
    rest = rows.join(many.hint("merge"), ["local_depth", "shard"], "left_anti")
    return rest.select(*rows.columns).unionByName(_placed(scratch, hot, limit).select(*rows.columns))


def _assigned(df: DataFrame, limit: int, key: str, text: str, split_ids: bool, payload: list) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be positive")
    scratch = Scratch(df.sparkSession, "sharding")
    n_bytes = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), hash_bits(key).alias("h"), n_bytes.alias("n_bytes"), F.xxhash64(F.col(text).cast("string")).alias("digest"), *payload)
    rows = scratch.table(rows.withColumn("place", F.monotonically_increasing_id()), "rows")
    placed = _placed(scratch, rows, limit)
    return _split(placed, limit) if split_ids else placed


def assign(df: DataFrame, *, limit: int, key: str = "doc_id", text: str = "text", split_ids: bool = False) -> DataFrame:
    """(doc_id, n_bytes, local_depth, shard, shard_bytes) of every row.

    n_bytes is the length of the text in UTF-8 (null: 0). `shard` is the number that the first local_depth
    bits of the hash make; the two name a shard. Rows of one id stay together, so a shard is over the limit
    only if it holds a single id (or ids of one hash); with `split_ids` such a shard splits on bits of text and
    place too, and only a single row can be over the limit. Rows with a null id count as one id. No rows
    give no rows; other columns are not looked at.
    """
    return _assigned(df, limit, key, text, split_ids, []).select("doc_id", "n_bytes", "local_depth", "shard", "shard_bytes")


def write(df: DataFrame, folder: str, *, limit: int, key: str = "doc_id", text: str = "text", split_ids: bool = False) -> DataFrame:
    """Write all rows as Parquet below `folder`, a folder for each shard, and return the assignment.

    Rows of a shard are written by one task. With `split_ids` they are bounded by the limit or are one row; without, an
    id over the limit is one task's.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    found = _assigned(df, limit, key, text, split_ids, [whole])
    name = F.concat_ws("-", F.col("local_depth"), F.col("shard")).alias("shard_name")
    found.select("row.*", name).repartition("shard_name").write.partitionBy("shard_name").parquet(folder)
    return found.select("doc_id", "n_bytes", "local_depth", "shard", "shard_bytes")


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
levels AS (SELECT docs.*, CAST(d AS INTEGER) AS d, h >> ({BITS} - CAST(d AS INTEGER)) AS shard FROM docs, generate_series(0, 30) AS t(d)),
buckets AS (SELECT d, shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM levels GROUP BY d, shard HAVING sum(n_bytes) <= {{limit}} OR min(h) = max(h))
SELECT doc_id, n_bytes, d AS local_depth, shard, shard_bytes FROM levels JOIN buckets USING (d, shard)
QUALIFY row_number() OVER (PARTITION BY doc_id, n_bytes ORDER BY d) = 1
"""


def oracle(limit: int) -> str:
    """The assignment of `documents` in SQL, for ids without repeats and leaves down to 30 bits."""
    return ORACLE.format(limit=limit)
