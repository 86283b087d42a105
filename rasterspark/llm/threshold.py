"""Exact top-k inner products by Fagin's threshold algorithm.

Inside a tile each dimension has the candidates sorted by that component. A query walks every list from
the end that its own component favours, in steps that double. Each step scores the candidates that
appear for the first time (random access), and the components reached bound the score of all that have
not appeared: sum of query component times component at the depth. The walk stops when that bound is
below the k-th score, so a candidate that could still enter, even by a tie, is always scored.

The depths at which the queries of a tile stop are found for all of them at once, from the k-th scores that earlier tiles have
reached. A walk that would read more list entries than the tile has candidates meets nearly all of them; the queries of
such walks, and those that have no k-th score yet, score the whole tile by one product.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rasterspark.llm import blocks
from rasterspark.session import Scratch

STEP = 16


def sorted_order(vectors: np.ndarray) -> np.ndarray:
    """For each dimension the places of a block's vectors by rising component."""
    return np.argsort(vectors, axis=0, kind="stable").astype(np.uint16 if len(vectors) <= 1 << 16 else np.int32)


class SortedLists:
    """Candidates of one block, sorted per dimension; `order` may have been made before."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray | None = None, order: np.ndarray | None = None):
        self.ids, self.vectors, self.own = ids, vectors, ids if own is None else own
        self.order = sorted_order(vectors) if order is None else order
        self.values = np.take_along_axis(vectors, self.order, axis=0)

    def top(self, query_own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best candidates but the query's own, and how many were scored.

        Candidates below `floor` may be left out.
        """
        n, dims = self.vectors.shape
        own = self.own == query_own
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = own.copy()
        at, scores = np.empty(0, np.int64), np.empty(0)
        depth, step = 0, STEP
        while depth < n:
            reach = min(n, depth + step)
            fresh = np.zeros(n, bool)
            fresh[self.order[n - reach : n - depth, up]] = True
            fresh[self.order[depth:reach, down]] = True
            if not len(up) and not len(down):  # a query of zeros scores 0 with all
                fresh[:] = True
                reach = n
            fresh &= ~seen
            new = np.flatnonzero(fresh)
            seen |= fresh
            at, scores = np.concatenate([at, new]), np.concatenate([scores, self.vectors[new] @ query])
            if len(at) >= k:
                kept = blocks.best_of(self.ids[at], scores, k)
                at, scores = at[kept], scores[kept]
            if reach < n:
                bound = self.values[n - 1 - reach, up] @ query[up] + self.values[reach, down] @ query[down]
                if bound < max(floor, scores.min() if len(at) == k else -np.inf):
                    break
            depth, step = reach, step * 2
        kept = blocks.best_of(self.ids[at], scores, k)
        return self.ids[at[kept]], scores[kept], int(seen.sum() - own.sum())


    def depths(self, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """For each query the depth after which no candidate that has not appeared reaches its floor; all candidates if there is none."""
        n = len(self.vectors)
        steps = STEP * ((1 << np.arange(1, max(1, n // STEP).bit_length() + 1)) - 1)
        steps = steps[steps < n]
        bounds = self.values[n - 1 - steps] @ np.maximum(queries, 0).T + self.values[steps] @ np.minimum(queries, 0).T
        stops = bounds < floors
        return np.where(stops.any(axis=0), steps[stops.argmax(axis=0)] if len(steps) else n, n)


class Exact:
    """Vectors of whole numbers, as float32 for products where every partial sum is exact in it."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(float)
        # a sum of |x y| is at most the product of the lengths, and whole numbers below 2**24 are exact in float32
        self.length = np.sqrt((self.vectors * self.vectors).sum(axis=1).max(initial=0)) * (1 + 1e-9)
        self.small = vectors.astype(np.float32) if self.length < 1 << 24 else None

    def times(self, other: Exact) -> np.ndarray:
        if self.length * other.length < 1 << 24 and self.small is not None and other.small is not None:
            return self.small @ other.small.T
        return self.vectors @ other.vectors.T


def left(block: blocks.Block) -> Exact:
    return Exact(block.vectors)


def right(block: blocks.Block) -> tuple[SortedLists, Exact]:
    order = blocks.numbers(block.more, *block.vectors.shape, {2: np.uint16, 4: np.int32})
    whole = Exact(block.vectors)
    return SortedLists(block.ids, whole.vectors, block.own, order), whole


def tile(k: int):
    def run(q_own: np.ndarray, q: Exact, c: tuple[SortedLists, Exact], floors: np.ndarray):
        lists, whole = c
        n, dims = lists.vectors.shape
        short = np.flatnonzero((floors > -np.inf) & (lists.depths(q.vectors, floors) * dims < n))
        walked = [lists.top(q_own[i], q.vectors[i], k, floors[i])[:2] for i in short]
        scores = q.times(whole) if len(short) < len(q_own) else np.empty((len(q_own), 0))
        if scores.size:
            at = blocks.met(q_own, lists.own)
            scores[at] = -np.inf
            scores[short] = -np.inf
            if len(new := np.flatnonzero(floors == -np.inf)) and n > k:
                floors = floors.copy()
                floors[new] = np.partition(scores[new], n - k, axis=1)[:, n - k]
        # rounding a floor down to float32 only lets more through
        least = np.nextafter(floors.astype(scores.dtype), -np.inf, dtype=scores.dtype)
        rows, cols = np.divmod(np.flatnonzero(scores > least[:, None]), max(1, scores.shape[1]))
        found = [(rows, lists.ids[cols], scores[rows, cols].astype(float)), *((np.full(len(i), p), i, s) for p, (i, s) in zip(short, walked, strict=True))]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    return run


def quantised(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", factor: int = 1024) -> DataFrame:
    """(vec_id, vector) of rows that take part, each component x as floor(factor * x), x as double.

    Null vectors, empty ones and those with a null or non-finite component take no part, nor do rows
    with a null id.
    """
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * factor).cast("double"))
    return df.where(F.col(key).isNotNull() & blocks.usable(vector)).select(F.col(key).cast("long").alias("vec_id"), whole.alias("vector"))


def top_k(df: DataFrame, *, every: int = 100, k: int = 10, key: str = "vec_id", vector: str = "embedding", factor: int = 1024, block_rows: int = blocks.BLOCK_ROWS, repeats: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of each query row.

    Queries are the rows whose id is divisible by `every`. With `repeats` every row but the query's own is a
    candidate, rows of its id and equal rows included; without, equal rows count once and no row of the
    query's id is a candidate. With fewer candidates all are returned. Equal scores go to the smaller id. Query rows of one id have k
    rows each. Only vectors of one length meet; scores are exact while |score| < 2**53. No rows give no rows; other columns are not looked at.
    """
    scratch = Scratch(df.sparkSession, "threshold")
    rows = blocks.numbered(scratch, quantised(df, key=key, vector=vector, factor=factor), repeats)
    return blocks.search(scratch, rows.where(F.col("vec_id") % every == 0), rows, left, right, tile(k), k, "long", block_rows, sorted_order)


#: The same in SQL, by scoring every pair.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 10
"""
