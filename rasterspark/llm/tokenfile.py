"""Token ids in Arrow stream files of equal-length sequences.

Format. A corpus is a set of shards; a shard is one uncompressed Arrow stream file with the columns
`input_ids` (fixed-size list of uint16, or uint32 for a vocabulary of more than 65,536 ids, `seq_len`
long) and `mask` (fixed-size list of booleans, true for a token and false for padding). Every record batch but the last has `rows_per_batch` rows, so all full
batches have one byte length. The documents of a shard follow each other in ascending id, each with
its end id, over the sequences; only the tail of a shard is padded. In a memory-mapped file any
sequence, mask (as an Arrow array over its bits) or token run is a view; nothing is copied. The index, a Parquet table, has one row
for each document: its shard, the file, the offset in the shard and its length.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyspark.sql.functions as F
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window

from rasterspark.llm.textbytes import flat, only, release, slices
from rasterspark.llm.units import UnitStore
from rasterspark.session import Scratch, make_dirs

_END = b"\xff\xff\xff\xff\0\0\0\0"  # fixed value: what ends an Arrow stream
SHARD_BYTES = 64 << 20  # of text in a shard, about
SEQ_LEN = 2048
ROWS_PER_BATCH = 32
END_ID = 2


def stream_schema(seq_len: int, rows_per_batch: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema(
        [pa.field("input_ids", pa.list_(kind, seq_len), nullable=False), pa.field("mask", pa.list_(pa.bool_(), seq_len), nullable=False)],
        metadata={"seq_len": str(seq_len), "rows_per_batch": str(rows_per_batch)},
    )


class TokenWriter:
    """Appends runs of ids to one stream file; holds at most one batch in memory."""

    def __init__(self, uri: str, seq_len: int = SEQ_LEN, rows_per_batch: int = ROWS_PER_BATCH, vocabulary: int = 1 << 32):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.seq_len, self.size = seq_len, seq_len * rows_per_batch
        self.schema = stream_schema(seq_len, rows_per_batch, vocabulary)
        self.out = fs.open_output_stream(path)
        self.writer = pa.ipc.new_stream(self.out, self.schema)
        self.held = np.zeros(self.size, np.uint16 if vocabulary <= 1 << 16 else np.uint32)
        self.used = self.written = 0

    def append(self, ids: np.ndarray) -> int:
        """Add ids and return the offset in the shard where they begin."""
        began, at = self.written, 0
        while at < len(ids):
            n = min(self.size - self.used, len(ids) - at)
            self.held[self.used : self.used + n] = ids[at : at + n]
            self.used += n
            at += n
            if self.used == self.size:
                self._flush()
        self.written += len(ids)
        return began

    def _flush(self) -> None:
        if not self.used:
            return
        rows = -(-self.used // self.seq_len)
        n = rows * self.seq_len
        ids = self.held[:n].copy()
        ids[self.used :] = 0
        mask = np.arange(n) < self.used
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.used = 0

    def close(self) -> None:
        self._flush()
        self.writer.close()
        self.out.close()


class TokenFile:
    """Random access to a shard. On a local or mounted path nothing is copied; elsewhere a batch is one ranged read."""

    def __init__(self, uri: str, mapped: bool | None = None):
        fs, path = pafs.FileSystem.from_uri(uri)
        mapped = isinstance(fs, pafs.LocalFileSystem) if mapped is None else mapped
        self.file = pa.memory_map(path) if mapped else fs.open_input_file(path)
        reader = pa.ipc.open_stream(self.file)
        self.schema = reader.schema
        self.seq_len = int(self.schema.metadata[b"seq_len"])
        self.rows_per_batch = int(self.schema.metadata[b"rows_per_batch"])
        self.size = self.seq_len * self.rows_per_batch
        # full batches have one length, so the place of each follows from the first
        self.first = self.file.tell()
        try:
            rows = reader.read_next_batch().num_rows
        except StopIteration:
            rows = 0
        self.step = self.file.tell() - self.first
        body = self.file.size() - self.first
        self.batches = 0 if not rows else 1 if rows < self.rows_per_batch else -(-(body - len(_END)) // self.step)
        self.held: tuple[int, np.ndarray, pa.BooleanArray] | None = None

    def _batch(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the i-th batch; the last one asked for is kept."""
        if not 0 <= i < self.batches:
            raise IndexError(f"batch {i} of {self.batches}")
        if self.held is None or self.held[0] != i:
            at = self.first + i * self.step
            message = pa.ipc.read_message(pa.BufferReader(self.file.read_at(min(self.step, self.file.size() - at), at)))
            batch = pa.ipc.read_record_batch(message, self.schema)
            self.held = (i, batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten())
        return self.held[1:]

    def __len__(self) -> int:
        """Number of sequences."""
        return (self.batches - 1) * self.rows_per_batch + len(self._batch(self.batches - 1)[0]) // self.seq_len if self.batches else 0

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the i-th sequence, as views."""
        batch, row = divmod(i, self.rows_per_batch)
        ids, mask = self._batch(batch)
        at = row * self.seq_len
        return ids[at : at + self.seq_len], mask.slice(at, self.seq_len)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start..start+n of the shard; a view if they lie in one batch."""
        batch, at = divmod(start, self.size)
        parts = []
        while n > 0:
            part = self._batch(batch)[0][at : at + n]
            parts.append(part)
            n -= len(part)
            batch, at = batch + 1, 0
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def _store(tokenizer_path: str, added_tokens: bool) -> tuple[UnitStore, int]:
    """The encoder of a tokenizer file, made once per Python worker, and its vocabulary's size."""
    return only(("tokenizer", tokenizer_path, added_tokens), lambda: _made(tokenizer_path, added_tokens))


def _made(tokenizer_path: str, added_tokens: bool) -> tuple[UnitStore, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path)
    own.encode_special_tokens = not added_tokens
    added = own.get_added_tokens_decoder().values() if added_tokens else ()
    if any(x.lstrip or x.rstrip or x.single_word or (x.normalized and own.normalizer is not None) for x in added):
        raise ValueError("an added token that depends on the text around it cannot be a unit")

    def encode(units: list[str]) -> list[list[int]]:
        out = []
        for k in range(0, len(units), 4096):
            out += [e.ids for e in own.encode_batch_fast(units[k : k + 4096], add_special_tokens=False)]
        return out

    return UnitStore(encode, whole=[x.content.encode() for x in added]), own.get_vocab_size()


def encoder(tokenizer_path: str) -> UnitStore:
    """The encoder of a tokenizer file to which the strings of added tokens are ordinary text."""
    return _store(tokenizer_path, False)[0]


INDEX = "shard int, path string, doc_id long, offset long, n_tokens long"


def write(df: DataFrame, folder: str, tokenizer_path: str, *, shards: int, seq_len: int = SEQ_LEN, rows_per_batch: int = ROWS_PER_BATCH, end_id: int = END_ID, key: str = "doc_id", text: str = "text", added_tokens: bool = False) -> DataFrame:
    """Encode whole texts and write them below `folder`, ascending by key over all shards.

    Returns the plan of the index; running it writes the files, so materialise it once. Each attempt of a
    task writes a file of its own name and only rows of attempts that were committed name their files, so
    lost executors and repeated tasks do no harm. A null text is empty (only its end id is written). Rows with
    a null key come first; rows with equal keys are ordered by a digest of the text, so that those of a hot key fill
    several shards, equal rows by their place. No rows give an empty index. With added_tokens
    the strings of the tokenizer's added tokens in a text get their own ids, as the library does unless it
    is told otherwise; without, they are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (own, vocabulary), writer = _store(tokenizer_path, added_tokens), None
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or TokenWriter(uri, seq_len, rows_per_batch, max(vocabulary, end_id + 1))
            data, offsets = flat(batch.column(1))
            for a, b in slices(offsets):
                base = offsets[a]
                ids, ends = own.encode_texts(data[base : offsets[b]], offsets[a : b + 1] - base)
                lengths = np.diff(ends) + 1
                began = writer.append(np.insert(ids, ends[1:], np.uint32(end_id)))
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard, np.int32)), pa.array([uri] * n, pa.string()), batch.column(0).slice(a, n).cast(pa.int64()), pa.array(began + np.cumsum(lengths) - lengths), pa.array(lengths, pa.int64())],
                    names=["shard", "path", "doc_id", "offset", "n_tokens"],
                )
        if writer:
            writer.close()
        release()

    text = F.col(f"`{text}`").cast("string")
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"), F.monotonically_increasing_id().alias("place"))
    order = ["doc_id", "digest", "place"]
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, INDEX)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, offset long"


def read_digests(index: DataFrame) -> DataFrame:
    """Read every document back from the files of a materialised index.

    `start` is the number of ids of all documents before it: the ids of earlier shards (a running sum over
    one row for each shard) plus its offset.
    """
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    base = totals.select("shard", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sums = np.empty(batch.num_rows, np.int64)
            lengths = np.empty(batch.num_rows, np.int64)
            for i, (p, at, n) in enumerate(zip(column["path"].to_pylist(), column["offset"].to_pylist(), column["n_tokens"].to_pylist(), strict=True)):
                if p != path:
                    path, file = p, TokenFile(p)
                ids = file.tokens(at, n)
                lengths[i] = len(ids)
                sums[i] = zlib.crc32(ids.astype("<u4"))
            start = np.asarray(column["base"].to_numpy(zero_copy_only=False), np.int64) + column["offset"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([column["doc_id"], pa.array(start), pa.array(lengths), pa.array(sums), column["shard"], column["offset"]], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"])

    return index.join(base, "shard").select("shard", "path", "doc_id", "offset", "n_tokens", "base").mapInArrow(run, READ)


def shards_for(df: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    """Shards of about `shard_bytes` of text each, and no fewer than the session's shuffle partitions."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))


def round_trip(spark: SparkSession, df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write `df` as token files in the shared folder and return the digests read back from them."""
    scratch = Scratch(spark, "tokens")
    make_dirs(spark, f"{scratch.path}/files")
    options.setdefault("shards", shards_for(df, options.get("text", "text")))
    index = scratch.table(write(df, f"{scratch.path}/files", tokenizer_path, **options), "index")
    return read_digests(index)
