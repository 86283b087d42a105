"""Blocks of vectors for searches of a query set against all rows.

Vectors become fixed-width rows of blocks, each block one binary value. A task gets a group of query blocks, which it
holds, and a group of candidate blocks, which go by one at a time: candidates are copied once for each group of queries and
queries once for each group of candidates, by a shuffle and never by a broadcast. Blocks are dealt by a hash of the row, so copies
of one vector and rows of one id spread. Only vectors of one length meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from rasterspark.session import Scratch

BLOCK_ROWS = 2048
QUERY_BLOCKS = 32  # that a task holds
CANDIDATE_BLOCKS = 128  # that go by in a task
FOUND = "query_row long, query_id long, vec_id long, score {kind}"
PARTS = ("rows", "own", "ids", "vectors", "more")


def usable(vector: str) -> Column:
    """Whether the vector is there and has only finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def numbered(scratch: Scratch, rows: DataFrame, repeats: bool) -> DataFrame:
    """(row, own, vec_id, vector, dims) from (vec_id, vector), written once so that row numbers stay.

    `own` is equal for a query and what is no candidate of it: its own row if rows may repeat; else equal rows
    become one, and no row of the query's id is a candidate.
    """
    rows = (rows if repeats else rows.distinct()).withColumn("row", F.monotonically_increasing_id())
    own = F.col("row" if repeats else "vec_id")
    return scratch.table(rows.select("row", own.alias("own"), "vec_id", "vector", F.size("vector").alias("dims")), "vectors")


def first_copies(scratch: Scratch, rows: DataFrame, most: int) -> DataFrame:
    """`numbered` rows with only the first `most` of equal vectors, by id; all rows if that would leave more than half of them.

    Equal vectors have equal scores, and ties go to the smaller id: a query that may meet all but one of them finds its
    `most` - 1 best among these. Copies are left out before the shuffle too, so no task gets all copies of a vector.
    """
    n, kinds = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("vector"))).first()
    if 2 * most * kinds > n:
        return rows
    place = F.row_number().over(Window.partitionBy("digest", "vector").orderBy("vec_id", "row"))
    first = rows.withColumn("digest", F.xxhash64("vector")).withColumn("copy", place).where(F.col("copy") <= most)
    return scratch.table(first.select(rows.columns), "first_copies")


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers as float32 where that holds all of them, else as float64."""
    small = values.astype(np.float32) if np.abs(values).max(initial=0) < 1e38 else values
    return small if np.array_equal(small, values) else values


def numbers(data: pa.Buffer, rows: int, dims: int, kinds: dict[int, type]) -> np.ndarray:
    """(rows, dims) of what was stored; the length tells the kind."""
    return np.frombuffer(data, kinds[data.size // max(1, rows * dims)]).reshape(rows, dims)


def pack(rows: DataFrame, n_blocks: int, more: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(dims, block, rows, own, ids, vectors, more), all but the first two binary, from what `numbered` gives.

    Components are stored as float32 where that is exact, else as float64, in the order of ids; `more` adds what a tile needs of the whole block,
    made once.
    """

    def gather(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        dims = key[0].as_py()
        data = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        parts = [*(group[n].to_numpy() for n in ("row", "own", "vec_id")), narrow(data), more(data) if more else np.empty(0)]
        return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(PARTS, parts, strict=True)}})

    dealt = rows.select("dims", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"), "row", "own", "vec_id", "vector")
    return dealt.groupBy("dims", "block").applyInArrow(gather, "dims int, block int, " + ", ".join(f"{n} binary" for n in PARTS))


class Block:
    """What a row of `pack` holds, in memory of its own."""

    def __init__(self, row: dict[str, pa.Scalar]):
        self.rows, self.own, self.ids = (np.frombuffer(row[n].as_buffer(), np.int64).copy() for n in ("rows", "own", "ids"))
        self.vectors = numbers(row["vectors"].as_buffer(), len(self.ids), row["dims"].as_py(), {4: np.float32, 8: np.float64}).copy()
        self.more = row["more"].as_buffer()


def met(q_own: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a query and what is no candidate of it."""
    order = np.argsort(own, kind="stable")
    first, last = (np.searchsorted(own[order], q_own, side) for side in ("left", "right"))
    q = np.flatnonzero(last > first)
    pairs = [(i, order[j]) for i in q.tolist() for j in range(first[i], last[i])]
    return np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64)


def search(scratch: Scratch, queries: DataFrame, candidates: DataFrame, left: Callable, right: Callable, tile: Callable, k: int, kind: str, block_rows: int = BLOCK_ROWS, more: Callable | None = None, query_blocks: int = QUERY_BLOCKS, candidate_blocks: int = CANDIDATE_BLOCKS) -> DataFrame:
    """The k best of (query_id, rank, vec_id, score) for each query row, ties to smaller vec_id.

    queries and candidates: rows of `numbered`. `left` and `right` make of a Block what `tile` needs of its queries or its candidates.
    `tile(query own, left, right, floors)` returns arrays of query places, ids and scores. It has at least the k best of the tile, but may leave
    out what is below its query's floor, the k-th score that earlier tiles of the task have reached.
    """
    n_candidates, n_queries = (max(1, -(-df.count() // block_rows)) for df in (candidates, queries))
    q_groups = -(-n_queries // query_blocks)
    c_groups = max(-(-n_candidates // candidate_blocks), min(n_candidates, -(-4 * scratch.spark.sparkContext.defaultParallelism // q_groups)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sides = [
        scratch.table(pack(queries, n_queries), "queries").select("dims", F.pmod("block", F.lit(q_groups)).alias("q"), every(c_groups).alias("c"), F.lit(0).alias("side"), "block", *PARTS),
        scratch.table(pack(candidates, n_candidates, more), "candidates").select("dims", every(q_groups).alias("q"), F.pmod("block", F.lit(c_groups)).alias("c"), F.lit(1).alias("side"), "block", *PARTS),
    ]
    typed = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(batch.schema.names)}
                if (now := tuple(row[n].as_py() for n in ("dims", "q", "c"))) != group:
                    for _, _, best in held:
                        yield from best.rows(typed)
                    group, held = now, []
                block = Block(row)
                if row["side"].as_py() == 0:
                    held.append((block, left(block), Best(block.rows, block.ids, k)))
                elif held:
                    whole = right(block)
                    for q, prepared, best in held:
                        best.add(*tile(q.own, prepared, whole, best.floors))
        for _, _, best in held:
            yield from best.rows(typed)

    # by number and not by hash, which leaves some tasks empty and gives others several groups
    dealt = sides[0].union(sides[1]).repartitionById(q_groups * c_groups, F.col("q") * c_groups + F.col("c")).sortWithinPartitions("dims", "q", "c", "side", "block")
    tiles = dealt.mapInArrow(run, FOUND.format(kind=kind))
    # row_number below k is also applied before the exchange, so a query sends k rows of each task at most
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return tiles.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best hits so far for each query row of a block."""

    def __init__(self, rows: np.ndarray, q_ids: np.ndarray, k: int):
        self.of, self.q_ids, self.k = rows, q_ids, k
        self.ids, self.scores = np.zeros((len(rows), k), np.int64), np.full((len(rows), k), -np.inf)  # by falling score

    @property
    def floors(self) -> np.ndarray:
        """The k-th score so far of each query row, minus infinity while it has fewer hits."""
        return self.scores[:, -1]

    def add(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(places):
            return
        hit, own = np.unique(places, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(hit)), self.k), own])
        ids, scores = np.concatenate([self.ids[hit].ravel(), ids]), np.concatenate([self.scores[hit].ravel(), scores.astype(float)])
        order = np.lexsort((ids, -scores, at))
        first = np.searchsorted(at[order], np.arange(len(hit)))
        kept = order[first[:, None] + np.arange(self.k)]
        self.ids[hit], self.scores[hit] = ids[kept], scores[kept]

    def rows(self, typed: pa.DataType) -> Iterator[pa.RecordBatch]:
        q, n = np.nonzero(self.scores > -np.inf)
        if len(q):
            scores = pa.array(self.scores[q, n])
            yield pa.RecordBatch.from_arrays([pa.array(self.of[q]), pa.array(self.q_ids[q]), pa.array(self.ids[q, n]), scores.cast(typed)], names=["query_row", "query_id", "vec_id", "score"])


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]
