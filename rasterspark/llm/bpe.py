"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a token itself.
Tier two: other pre-tokens are merged with a heap of candidate pairs over linked byte runs.
Decoding gathers the bytes of the tokens.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyspark.sql.functions as F
import regex
from pyspark.sql import DataFrame

from rasterspark.llm.textbytes import flat, mix, only, release, slices, span_hashes
from rasterspark.llm.units import UnitStore


class PerfectHash:
    """Minimal perfect hash: n keys to the slots 0..n-1, by one displacement per bucket.

    Buckets are placed largest first; a bucket of one key takes any slot that is still free, which its
    entry names directly (as -slot - 1).
    """

    def __init__(self, keys: list[bytes]):
        if len(set(keys)) != len(keys):
            raise ValueError("keys must be distinct")
        self.n = len(keys)
        self.buckets = max(1, self.n // 2)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slots: list[bytes] = [b""] * self.n
        if not keys:
            return
        hashes = self._hashes(keys)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(edges)
        taken = np.zeros(self.n, bool)
        rest: list[int] = []
        for b in np.argsort(-sizes, kind="stable"):
            members = order[edges[b] : edges[b + 1]]
            if len(members) == 0:
                break
            if len(members) == 1:
                rest.append(int(b))
                continue
            own, first = hashes[members], 1
            while True:
                seeds = np.arange(first, first + 64)
                tried = self._slot(own, seeds[:, None])
                tried.sort(axis=1)
                fits = ~taken[tried].any(axis=1) & (tried[:, 1:] != tried[:, :-1]).all(axis=1)
                if fits.any():
                    break
                first += 64
            seed = int(seeds[np.argmax(fits)])
            at = self._slot(own, np.int64(seed))
            taken[at] = True
            self.shift[b] = seed
            for m, s in zip(members, at, strict=True):
                self.slots[s] = keys[m]
        for b, s in zip(rest, np.flatnonzero(~taken), strict=True):
            self.shift[b] = -int(s) - 1
            self.slots[s] = keys[order[edges[b]]]

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(k) for k in keys])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return span_hashes(np.frombuffer(b"".join(keys), np.uint8), starts, ends)

    def _slot(self, hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        return (mix(hashes + np.asarray(seeds).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """Slot of each key, or -1 for a key that is not in the set."""
        if not keys or not self.n:
            return [-1] * len(keys)
        hashes = self._hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        at = np.where(shift < 0, -shift - 1, self._slot(hashes, np.maximum(shift, 0))).tolist()
        slots = self.slots
        return [s if slots[s] == k else -1 for s, k in zip(at, keys, strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, is joined until none is left."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the run that starts here; 0: no run starts here any more
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, mid, stop = heappop(heap)
        if end[i] != mid or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, stop, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
            heappush(heap, (r, left, i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder for a rank file; each match of `pattern` is encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        tokens = list(ranks)
        self.table = PerfectHash(tokens)
        self.slot_ids = [ranks[t] for t in self.table.slots]
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, i in ranks.items():
            by_id[i] = t
        self.bytes_of = pa.array(by_id, pa.large_binary())
        self.digits_of = pa.array([b"%d " % i for i in range(len(by_id))], pa.large_binary())
        self.store = UnitStore(self.encode_units)

    def encode_units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit; equal pre-tokens among them are resolved once."""
        find = self.pattern.findall
        pieces = [find(u) for u in units]
        keys = {p: None for ps in pieces for p in ps}
        raw = [p.encode("utf-8", "surrogateescape") for p in keys]
        known: dict[str, list[int]] = {}
        for p, b, s in zip(keys, raw, self.table.find(raw), strict=True):
            known[p] = [self.slot_ids[s]] if s >= 0 else merge(b, self.ranks)
        return [known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]] for ps in pieces]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and the offsets of the texts."""
        data, offsets = flat(column)
        return self.store.encode_texts(data, offsets)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        return _gather(self.bytes_of, ids, offsets)

    def digits(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The decimal ids of each text, joined by one space."""
        return [x[:-1] for x in _gather(self.digits_of, ids, offsets)]


def _gather(of: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    taken = of.take(pa.array(ids.astype(np.int64)))
    if not len(taken):
        return [b""] * (len(offsets) - 1)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = memoryview(taken.buffers()[2]) if taken.buffers()[2] is not None else memoryview(b"")
    at = ends[offsets]
    return [bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def codec(rank_path: str, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """The codec of a rank file (a bounded vocabulary), made once per Python worker."""

    def make() -> Codec:
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        return Codec(ranks, pattern)

    return only(("codec", rank_path, pattern), make)


def encode(df: DataFrame, rank_path: str, text: str = "text", ids: str = "token_ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Add an array<int> column with the ids of each whole text (null: no ids).

    Columns in `keep` are carried (all by default); one already called `ids` is replaced. A null or empty
    text has an empty array, an empty table stays empty. `decoded` names a further column with the SHA-256
    of the bytes that the ids decode to.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    added = [StructField(ids, ArrayType(IntegerType()))] + ([StructField(decoded, StringType())] if decoded else [])
    keep = [c for c in (df.columns if keep is None else keep) if c not in {f.name for f in added}]
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = StructType([*(df.schema[c] for c in keep), *added])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path)
        for batch in batches:
            data, offsets = flat(batch.column(len(keep)))
            for a, b in slices(offsets):
                base = offsets[a]
                got, ends = own.store.encode_texts(data[base : offsets[b]], offsets[a : b + 1] - base)
                part = batch.slice(a, b - a)
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(got.astype(np.int32))).cast(arrow.field(len(keep)).type))
                if decoded:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(got, ends)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        release()

    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add a binary column with the bytes that an array column of ids stands for (null: empty)."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.types import BinaryType

    @arrow_udf(BinaryType())
    def back(column: pa.Array) -> pa.Array:
        own, parts = codec(rank_path), []
        for a in range(0, len(column), 512):
            part = column.slice(a, 512)
            lengths = part.value_lengths().fill_null(0).to_numpy()
            parts += own.decode(part.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
        return pa.array(parts, pa.binary())

    return df.withColumn(out, back(F.col(ids)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean"


def digest(df: DataFrame, rank_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every whole text and return one row of digests for each.

    `exact` says whether the decoded bytes are those of the text. A null text counts as empty; rows with
    a null key and repeated rows keep a row each; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            column = batch.column(1)
            data, offsets = flat(column)
            for a, b in slices(offsets):
                base = offsets[a]
                ids, ends = own.store.encode_texts(data[base : offsets[b]], offsets[a : b + 1] - base)
                plain = own.decode(ids, ends)
                raw = data[base : offsets[b]].tobytes()
                cuts = (offsets[a : b + 1] - base).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        pa.array(np.diff(ends), pa.int64()),
                        pa.array([sha(x) for x in own.digits(ids, ends)], pa.string()),
                        pa.array([sha(x) for x in plain], pa.string()),
                        pa.array([x == raw[s:e] for x, s, e in zip(plain, cuts[:-1], cuts[1:], strict=True)], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
                )
        release()

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, DIGEST)
