"""Token files and byte-level BPE against the tokenizers and tiktoken libraries."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rasterspark.llm import bpe, tokenfile
from rasterspark.llm.units import cut

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", "  a  b ", "a\n\nb", " \n x", "x \n", "a\xa0 b 　c", "don't  it's 'll\n'x", "\ta b\t\tc", "a\x1c b \x1f c", "é ü\nß  \n\n ñ ", "<|endoftext|> hi", "a " * 3000, "1234 567\n89", "a\n b", "a\n", "\na", "日本 語\n テスト ", "x" * 5000]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def table(spark, rows, schema="doc_id long, text string, token_ids string, shard int, path string"):
    return spark.createDataFrame(rows, schema)


def test_units_tile_the_text():
    data = np.frombuffer("ab cd\nef  gh\n\ni, (j's)".encode(), np.uint8)
    starts = cut(data, np.array([0, len(data)]))
    pieces = [bytes(data[a:b]).decode() for a, b in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert pieces == ["ab", " cd", "\n", "ef ", " gh\n\ni", ",", " (", "j", "'s", ")"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab1 \n\t'é\xa0　 .s\x1c日"), max_size=14), max_size=6))
def test_encoder_equals_the_library(texts):
    ranks = bpe.codec(RANKS).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, ends = bpe.codec(RANKS).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [library.encode_ordinary(t) for t in texts]


def test_perfect_hash_is_minimal_and_exact():
    keys = [b"%d" % i for i in range(3000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.find(keys)) == list(range(3000))
    assert set(table.find([b"x", b"", b"3001"])) == {-1}
    assert bpe.PerfectHash([]).find([b"a"]) == [-1]


def test_store_forgets_without_changing_results():
    own = bpe.codec(RANKS)
    small = bpe.UnitStore(own.encode_units, limit=2)
    for text in ODD:
        data = np.frombuffer(text.encode(), np.uint8)
        got, _ = small.encode_texts(data, np.array([0, len(data)]))
        want, _ = own.encode(pa.array([text]))
        assert got.tolist() == want.tolist()


def test_digest_nulls_repeats_and_clashing_columns(spark, reference):
    rows = [(i, t, "x", 1, "p") for i, t in enumerate(ODD)] + [(None, "null id", "x", 1, "p"), (99, None, None, None, None), (3, ODD[3], "x", 1, "p")]
    got = sorted(tuple(r) for r in bpe.digest(table(spark, rows), RANKS).fillna(-1, ["doc_id"]).collect())
    want = []
    for key, text, *_ in rows:
        ids = reference.encode_ordinary(text or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
        want.append((-1 if key is None else key, len(ids), *sha, True))
    assert got == sorted(want)


def test_encode_and_decode_columns(spark):
    df = table(spark, [(1, "Hello  world\n", "old", 2, "p"), (2, None, None, None, None), (3, "", None, None, None)])
    out = bpe.decode(bpe.encode(df, RANKS), RANKS).orderBy("doc_id").collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "shard", "path", "token_ids", "decoded"}
    assert [bytes(r.decoded) for r in out] == [b"Hello  world\n", b"", b""]
    assert out[2].token_ids == [] and out[1].text is None


def test_digest_of_an_empty_table(spark):
    assert bpe.digest(table(spark, []), RANKS).collect() == []


def expected_files(rows):
    library = Tokenizer.from_file(JSON)
    library.encode_special_tokens = True
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("seq_len", "rows_per_batch"), [(8, 2), (2048, 32)])
def test_files_read_back(spark, seq_len, rows_per_batch):
    rows = [(i * 3 % 17, t) for i, t in enumerate(ODD[:17])] + [(40, None), (41, ODD[3]), (41, ODD[3]), (None, "no id")]
    df = table(spark, [(k, t, "x", 1, "p") for k, t in rows])
    got = tokenfile.round_trip(spark, df, JSON, shards=3, seq_len=seq_len, rows_per_batch=rows_per_batch)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got.collect()) == [(s, k, n, c) for k, s, n, c in expected_files(rows)]


def test_added_tokens_get_the_ids_of_the_unmodified_library():
    library = Tokenizer.from_file(JSON)
    end = "<|endoftext|>"
    texts = [*ODD, f"a {end} b", f"a  {end}  b", f"{end}{end}", f"x{end}", f"{end}y\n{end}\nz", f"a\n {end}'s", "<|endoftext|", "|>", end[:5], end[5:], f"<|end{end}oftext|>", f"don'{end}t"]
    store, _ = tokenfile._store(JSON, True)
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    ids, ends = store.encode_texts(np.frombuffer(data, np.uint8), offsets)
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[len(ODD)]


def test_no_rows_give_no_files(spark):
    assert tokenfile.round_trip(spark, table(spark, []), JSON, shards=2).collect() == []


def test_random_access_does_not_copy(tmp_path):
    ids = np.arange(100, dtype=np.uint32)
    writer = tokenfile.TokenWriter(f"file://{tmp_path}/a.arrow", 8, 4)
    assert writer.append(ids[:30]) == 0 and writer.append(ids[30:]) == 30
    writer.close()
    file = tokenfile.TokenFile(f"file://{tmp_path}/a.arrow")
    assert len(file) == 13
    row, mask = file.sequence(12)
    assert row.tolist() == [96, 97, 98, 99, 0, 0, 0, 0] and mask.to_pylist() == [True] * 4 + [False] * 4
    assert file.tokens(3, 60).tolist() == list(range(3, 63))
    view = file.tokens(33, 20)
    assert view.base is not None and view.tolist() == list(range(33, 53))
    sizes = {b.nbytes for b in list(pa.ipc.open_stream(pa.memory_map(f"{tmp_path}/a.arrow")))[:-1]}
    assert len(sizes) == 1


def library_rows(rows):
    """doc_id, start, n_tokens and crc of each row by the unmodified library, for distinct ids."""
    library, out, start = Tokenizer.from_file(JSON), [], 0
    for key, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_registered_token_files_equal_the_unmodified_library(spark):
    from rasterspark.llm.queries import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = queries()["op1_token_file"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == library_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_special_strings_in_files_get_the_library_s_ids(spark):
    end = "<|endoftext|>"
    rows = [(i, t.replace("Z", end)) for i, t in enumerate(["a Z b", "Z", "ZZ x", "no mark", " Z\n", "Zs don'Zt", "", "x" * 9000 + "Z" * 700])]
    got = tokenfile.round_trip(spark, table(spark, [(k, t, "x", 1, "p") for k, t in rows]), JSON, shards=3, seq_len=8, rows_per_batch=2, added_tokens=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == library_rows(rows)


def test_a_hot_key_fills_several_shards(spark):
    rows = [(5, f"text number {i}") for i in range(400)] + [(5, "same")] * 300 + [(1, "first"), (9, "last"), (None, "none")]
    got = tokenfile.round_trip(spark, table(spark, [(k, t, "x", 1, "p") for k, t in rows]), JSON, shards=6).collect()
    assert len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in by_start])
    assert [r.start for r in by_start] == [0, *ends[:-1]]
    assert [r.doc_id for r in by_start] == [None, 1, *[5] * 700, 9]
    shards = [r.shard for r in got]
    assert max(map(shards.count, set(shards))) < 300


def test_shards_follow_from_bytes(spark):
    df = table(spark, [(i, "word " * 200, "x", 1, "p") for i in range(50)])
    assert tokenfile.shards_for(df, shard_bytes=1000) == 50 and tokenfile.shards_for(df) == 4
    assert tokenfile.shards_for(df.limit(0)) == 4


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 64, 100])
def test_ranged_reads_equal_mapped_ones(tmp_path, n):
    uri, ids = f"file://{tmp_path}/a.arrow", np.arange(1, n + 1, dtype=np.uint32)
    writer = tokenfile.TokenWriter(uri, 8, 4, 1000)
    writer.append(ids)
    writer.close()
    near, far = tokenfile.TokenFile(uri), tokenfile.TokenFile(uri, mapped=False)
    assert len(near) == len(far) == -(-n // 8)
    for a in range(0, n, 7):
        assert near.tokens(a, min(45, n - a)).tolist() == far.tokens(a, min(45, n - a)).tolist() == ids[a : a + 45].tolist()
    for i in range(len(near)):
        (x, m), (y, k) = near.sequence(i), far.sequence(i)
        assert x.tolist() == y.tolist() and m.to_pylist() == k.to_pylist()
    with pytest.raises(IndexError):
        near.sequence(len(near) + 4)


def test_counts_agree_with_the_ids():
    own = tokenfile.encoder(JSON)
    data, offsets = "".join(ODD).encode(), np.cumsum([0, *(len(t.encode()) for t in ODD)])
    flat = np.frombuffer(data, np.uint8)
    ids, ends = own.encode_texts(flat, offsets)
    tokens, first, units = own.counts(flat, offsets)
    assert tokens.tolist() == np.diff(ends).tolist() and len(first) == units.sum()
    begins = np.cumsum(units) - units
    assert all(first[b] == ids[e] for b, e, n in zip(begins, ends, tokens, strict=False) if n)
    assert [x.tolist() for x in own.counts(flat[:0], np.zeros(3, np.int64))] == [[0, 0], [], [0, 0]]
