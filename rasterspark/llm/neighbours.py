"""Nearest neighbours by cosine from int8 product tiles.

Unit vectors are rounded to int8 with a scale of their own. The product of two int8 blocks gives an
approximate cosine of every pair of a tile, and the rounding errors of both sides bound how far it can be
from the true one. A pair whose upper bound does not reach the k-th lower bound of its query is
dropped; the others are computed again in double precision, and the best of each query are kept
over the tiles. Since bounds hold for every pair the result is exact. Where most rows are copies, only the first k + 1 of
equal vectors are candidates, which changes no result.
"""

from __future__ import annotations

import numpy as np
import pyspark.sql.functions as F
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType

from rasterspark.llm import blocks
from rasterspark.session import Scratch

#: Rows of a block, and the blocks that a task holds and that go by in it: with 64 components a held query takes 0.45 kB, and candidates 0.43 MB a block
#: while they are sorted. Larger groups are copied less often.
BLOCK_ROWS, QUERY_BLOCKS, CANDIDATE_BLOCKS = 1536, 160, 320


class Quantised:
    """Unit vectors as int8 times a scale, with the length of each rounding error."""

    def __init__(self, vectors: np.ndarray):
        # scaling by the largest component first keeps squares of tiny and huge numbers in range
        peak = np.abs(vectors).max(axis=1, keepdims=True)
        scaled = vectors / peak
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((unit - self.codes * self.scale[:, None]) ** 2).sum(axis=1)) + 1e-12


def _in_range(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring the largest component near 1, so that no square overflows; exact."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision: x.y / sqrt(x.x * y.y).

    Sums run over the components in their order and depend on the two rows only, so copies of a vector have equal scores.
    """
    a, b = (np.ascontiguousarray(_in_range(x).T) for x in (a, b))
    dot, aa, bb = np.zeros((3, a.shape[1]))
    for x, y in zip(a, b, strict=True):
        dot += x * y
        aa += x * x
        bb += y * y
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


class Side:
    """Ids, vectors and quantised vectors of one block."""

    def __init__(self, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.own, self.ids, self.vectors = own, ids, vectors
        coded = Quantised(vectors.astype(float))
        self.codes, self.scale, self.error = coded.codes, coded.scale, coded.error
        # whole numbers below 2**24 in float32 are exact: an int8 product through the fast kernel
        self.kind = np.dtype(np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64)


def side(block: blocks.Block) -> Side:
    return Side(block.own, block.ids, block.vectors)


#: More than what a cosine changes by two roundings to float32.
ROUNDING = 1e-6


def near(k: int, step: int = 256):
    def run(q_own: np.ndarray, left: Side, right: Side, floors: np.ndarray):
        n = len(right.ids)
        own_q, own_c = blocks.met(q_own, right.own)
        codes, scale = right.codes.astype(right.kind), right.scale.astype(right.kind)
        # |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|, with |y| = 1 and |x'| <= 1 + |x - x'|; the largest error of the candidates holds for all
        slack = left.error + (1 + left.error) * right.error.max() + ROUNDING
        out_q, out_c = [], []
        for s in range(0, len(q_own), step):
            part = slice(s, s + step)
            cosine = left.codes[part].astype(right.kind) @ codes.T  # times the query's scale, which is left to the other side of the comparison
            cosine *= scale
            mine = (own_q >= s) & (own_q < s + step)
            cosine[own_q[mine] - s, own_c[mine]] = -np.inf
            kth = floors[part].copy()
            if len(new := np.flatnonzero(kth == -np.inf)) and n > k:
                kth[new] = np.partition(cosine[new], n - k, axis=1)[:, n - k] * left.scale[part][new] - slack[part][new]
            least = ((kth - slack[part]) / left.scale[part]).astype(cosine.dtype)
            rows, cols = np.divmod(np.flatnonzero(cosine > np.nextafter(least, -np.inf, dtype=least.dtype)[:, None]), n)
            out_q.append(s + rows)
            out_c.append(cols)
        q, c = np.concatenate(out_q), np.concatenate(out_c)
        exact = np.concatenate([np.empty(0), *(cosines(left.vectors[q[i : i + 65536]].astype(float), right.vectors[c[i : i + 65536]].astype(float)) for i in range(0, len(q), 65536))])
        kept = exact >= floors[q]
        return q[kept], right.ids[c[kept]], exact[kept]

    return run


def tile(k: int, step: int = 256):
    """The same on plain arrays, with the k best of each query only."""

    def run(q_own: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, floors: np.ndarray, own: np.ndarray | None = None):
        best = blocks.Best(q_own, q_own, k)
        best.add(*near(k, step)(q_own, Side(q_own, q_own, q), Side(ids if own is None else own, ids, c), floors))
        rows, cols = np.nonzero(best.scores > -np.inf)
        return rows, best.ids[rows, cols], best.scores[rows, cols]

    return run


def nearest(df: DataFrame, *, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, repeats: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest cosines of each query row, nearest first.

    Queries are the rows whose id is divisible by `every`. With `repeats` every row but the query's own is a
    candidate, rows of its id and equal rows included; without, equal rows count once and no row of the
    query's id is a candidate. With fewer candidates all are returned. Equal scores go to the smaller id. Query rows of one id have k
    rows each. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
    with a null id. Only vectors of one length meet. No rows give no rows; other columns are not looked at.
    """
    scratch = Scratch(df.sparkSession, "neighbours")
    some = F.exists(F.col(vector), lambda x: x != 0)
    kind = df.select(F.col(vector)).schema[0].dataType
    components = F.col(vector) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else F.col(vector).cast("array<double>")
    rows = df.where(F.col(key).isNotNull() & blocks.usable(vector) & some).select(F.col(key).cast("long").alias("vec_id"), components.alias("vector"))
    rows = blocks.numbered(scratch, rows, repeats)
    candidates = blocks.first_copies(scratch, rows, k + 1)
    out = blocks.search(scratch, rows.where(F.col("vec_id") % every == 0), candidates, side, side, near(k), k, "double", block_rows, query_blocks=QUERY_BLOCKS, candidate_blocks=CANDIDATE_BLOCKS)
    scratch.drop_all_but("queries", "candidates")
    df.sparkSession.sparkContext._jvm.System.gc()  # shuffle files of the steps before go with the driver's garbage
    return out


#: The same in SQL, by scoring every pair.
ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored QUALIFY rank <= 5
"""
