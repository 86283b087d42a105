"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts, vectorised over the bytes of a batch. The trees are grown on the driver
from a bounded sample of labelled rows and flattened into arrays that numpy walks for all rows and
trees at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from rasterspark.llm.textbytes import flat, lower_ascii, release, shingles, slices, span_hashes, words

SAMPLE_ROWS = 20_000  # bound of the labelled rows that reach the driver, on average
TREES = 80
DEPTH = 4
RATE = 0.15
BINS = 64
THRESHOLD = 0.3

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "high": range(0x80, 0x100),
    "space": b" \t\v\f\r",
    "newline": b"\n",
    "stop": b".",
    "comma": b",;:",
    "exclaim": b"!",
    "question": b"?",
    "bar": b"|",
    "amp": b"&",
    "dollar": b"$",
    "percent": b"%",
    "star": b"*",
    "hash": b"#",
    "quote": b"\"'`",
    "bracket": b"()[]{}<>",
    "sign": b"=+-_/\\@~^",
}
_CLASS = np.full(256, len(CLASSES), np.int64)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS[list(_bytes)] = _k
_WIDTH = len(CLASSES) + 1
STATISTICS = [
    *(f"share_{c}" for c in CLASSES), "share_other", "log_bytes", "log_words", "log_lines", "word_mean", "word_spread", "line_mean",
    "distinct_words", "distinct_shingles", "distinct_lines", "long_words", "one_byte_words", "marked_words", "capital_words", "stops_per_word",
]


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Number of distinct hashes in each row (of 44 bits of them; these are statistics)."""
    rows = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    key = np.sort((rows << np.uint64(44)) | (hashes >> np.uint64(20)))
    if not len(key):
        return np.zeros(len(counts))
    first = np.concatenate([[True], key[1:] != key[:-1]])
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=len(counts)).astype(float)


def _sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(counts)), counts), values, len(counts))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    byte_class = _CLASS[data]
    shares = np.bincount(row * _WIDTH + byte_class, minlength=n * _WIDTH).reshape(n, _WIDTH) / np.maximum(sizes, 1)[:, None]
    low = lower_ascii(data)
    starts, ends, counts = words(low, offsets)
    hashes, lengths = span_hashes(low, starts, ends), (ends - starts).astype(float)
    per_word = np.maximum(counts, 1)
    mean = _sum(lengths, counts) / per_word
    spread = np.sqrt(np.maximum(_sum(lengths * lengths, counts) / per_word - mean * mean, 0))
    grams, gram_counts = shingles(hashes, counts, 3)
    # lines: runs between newlines, as spans that tile each text
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
    line_starts, line_ends = cuts[:-1], cuts[1:]
    lines = np.diff(np.searchsorted(line_starts, offsets))
    line_hashes = span_hashes(low, line_starts, line_ends)
    letter = np.isin(byte_class[ends - 1], (0, 1, 3)) if len(ends) else np.empty(0, bool)
    marked = (~letter & ~np.isin(byte_class[ends - 1], (6, 7))).astype(float) if len(ends) else np.empty(0)
    columns = [
        np.log1p(sizes), np.log1p(counts), np.log1p(lines), mean, spread, sizes / np.maximum(lines, 1),
        _distinct(hashes, counts) / per_word, _distinct(grams, gram_counts) / np.maximum(gram_counts, 1), _distinct(line_hashes, lines) / np.maximum(lines, 1),
        _sum((lengths > 15).astype(float), counts) / per_word, _sum((lengths == 1).astype(float), counts) / per_word,
        _sum(marked, counts) / per_word, _sum((byte_class[starts] == 0).astype(float) if len(starts) else np.empty(0), counts) / per_word,
        shares[:, 6] * sizes / per_word,
    ]
    return np.column_stack([shares, *columns]).astype(np.float32)


def measure(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, stats array<float>) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in slices(offsets):
                base = offsets[a]
                got = statistics(data[base : offsets[b]], offsets[a : b + 1] - base)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, got.shape[1], dtype=np.int32)), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), lists], names=["doc_id", "stats"])
        release()

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, stats array<float>")


@dataclass(frozen=True)
class Forest:
    """Flattened trees. Node arrays of all trees lie one after the other; a leaf points to itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        out = np.full(len(x), self.base)
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[a : a + 4096] += self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, penalty: float = 1.0, least: float = 1.0) -> Forest:
    """Boost trees of logistic loss on histograms of `bins` quantile bins, level by level.

    Without rows the score is 0.5 everywhere, with one class it is that class's smoothed share.
    """
    n, width = x.shape
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    empty = Forest(*(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0, np.float32), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(0), base, 0)
    if n == 0 or y.min() == y.max():
        return empty
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="lower")).astype(np.float32) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    cells = binned + np.arange(width) * bins  # x <= edges[b] if and only if its bin is at most b
    usable = np.zeros((width, bins), bool)
    for j, e in enumerate(edges):
        usable[j, : len(e)] = True
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots, logit = [], np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0, len(nodes), len(nodes), 0])
        where = np.full(n, roots[-1])
        level = [roots[-1]]
        for step in range(depth + 1):
            slot = np.full(len(nodes), -1)
            slot[level] = np.arange(len(level))
            live = np.flatnonzero(slot[where] >= 0)
            own = slot[where[live]]
            g, h = np.bincount(own, grad[live], len(level)), np.bincount(own, hess[live], len(level))
            for k, node in enumerate(level):
                nodes[node][4] = -rate * g[k] / (h[k] + penalty)
            if step == depth:
                break
            size = width * bins
            flat_cells = (own[:, None] * size + cells[live]).ravel()
            gs, hs = (np.bincount(flat_cells, np.repeat(v[live], width), len(level) * size).reshape(len(level), width, bins).cumsum(axis=2) for v in (grad, hess))
            rest_g, rest_h = g[:, None, None] - gs, h[:, None, None] - hs
            gain = gs**2 / (hs + penalty) + rest_g**2 / (rest_h + penalty) - (g**2 / (h + penalty))[:, None, None]
            gain[~(usable[None] & (hs >= least) & (rest_h >= least))] = -np.inf
            flat_gain = gain.reshape(len(level), -1)
            best = flat_gain.argmax(axis=1)
            following = []
            for k, node in enumerate(level):
                if not flat_gain[k, best[k]] > 1e-6:
                    continue
                j, b = divmod(int(best[k]), bins)
                kids = len(nodes), len(nodes) + 1
                nodes[node][:4] = [j, float(edges[j][b]), *kids]
                nodes.extend([0, 0, i, i, 0] for i in kids)
                mine = live[own == k]
                where[mine] = np.where(binned[mine, j] <= b, kids[0], kids[1])
                following += kids
            level = following
            if not level:
                break
        table = np.array([node[4] for node in nodes])
        logit += table[where]
    flatten = np.array(nodes, float)
    ints = [flatten[:, k].astype(np.int64) for k in (0, 2, 3)]
    return Forest(np.array(roots), ints[0], flatten[:, 1].astype(np.float32), ints[1], ints[2], flatten[:, 4], base, depth)


def _sample(labels: DataFrame, key: str, label: str, sample_rows: int) -> DataFrame:
    """(doc_id, label) of at most `sample_rows` labelled ids, those of the smallest hashes; repeated labels of an id vote, 1 on a tie."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), (F.col(label) > 0).cast("int").alias("label"))
    voted = known.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    return voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def train(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Forest:
    """Fit on the statistics of labelled rows, `sample_rows` of them at most whatever keys repeat.

    Rows without statistics, with a null key or a null label teach nothing; a label above 0 counts as 1. Of the
    rows of one id one teaches, that of the smallest statistics.
    """
    known = F.broadcast(_sample(labels, key, label, sample_rows))  # bounded by the parameter
    one = measured.join(known, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("stats").alias("stats"))
    rows = one.toPandas().sort_values("doc_id")
    x = np.array(rows["stats"].tolist(), np.float32).reshape(len(rows), len(STATISTICS))
    return grow(x, rows["label"].to_numpy(float), **options)


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS, **options) -> Forest:
    """`train` on documents of which only the sampled ones are measured."""
    known = docs.sparkSession.createDataFrame(_sample(labels, key, label, sample_rows).toArrow())  # bounded by the parameter; no Python workers
    wanted = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    taught = wanted.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    return train(measure(taught), known, label="label", sample_rows=sample_rows, **options)


SCORED = "doc_id long, score double, predicted int"


def score(measured: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every measured row; the forest is bounded by its parameters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(STATISTICS))
            got = forest.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.select("doc_id", "stats").mapInArrow(run, SCORED)


def keep(df: DataFrame, forest: Forest, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df`, with all their columns, whose text scores `threshold` or more.

    Scored row by row in one pass, so null and repeated ids need no join; a null text counts as empty.
    """
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.types import BooleanType

    @arrow_udf(BooleanType())
    def good(column: pa.Array) -> pa.Array:
        data, offsets = flat(column)
        out = np.empty(len(column), bool)
        for a, b in slices(offsets):
            base = offsets[a]
            out[a:b] = forest.score(statistics(data[base : offsets[b]], offsets[a : b + 1] - base)) >= threshold
        release()
        return pa.array(out)

    return df.where(good(F.col(f"`{text}`").cast("string")))
