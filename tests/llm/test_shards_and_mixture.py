"""Extendible hashing and raking against brute force, and the whole pipeline."""

import hashlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest
from pyspark.sql.functions import arrow_udf

from rasterspark.llm import mixing, sharding
from rasterspark.llm.queries import TARGETS

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, h int, taken string"


def brute_shards(rows, limit):
    items = [(k, len((t or "").encode()), int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16)) for k, t in rows]
    out, stack = [], [(0, 0, items)]
    while stack:
        depth, prefix, held = stack.pop()
        size = sum(n for _, n, _ in held)
        if size <= limit or len({h for *_, h in held}) <= 1:
            out += [(-1 if k is None else k, n, depth, prefix, size) for k, n, _ in held]
            continue
        for bit in (0, 1):
            part = [x for x in held if x[2] >> (59 - depth) & 1 == bit]
            if part:
                stack.append((depth + 1, prefix * 2 + bit, part))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", 1, "x", 2, "y") for k, t in rows], DOCS)


@pytest.mark.parametrize("limit", [1, 60, 1000, 10**9])
def test_shards_equal_brute_force(spark, limit):
    rows = [(i, "é" * (i * 7 % 50)) for i in range(150)] + [(3, "again" * 30), (3, "again" * 30), (None, "none"), (None, None), (777, "x" * 5000), (778, None)]
    got = sharding.assign(frame(spark, rows), limit=limit).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == brute_shards(rows, limit)


def test_deep_splits_take_further_rounds(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPARE", 0)
    monkeypatch.setattr(sharding, "STEP", 3)
    rows = [(i, "x" * (5000 if i == 9 else 10)) for i in range(200)]
    got = sharding.assign(frame(spark, rows), limit=30).collect()
    assert sorted(tuple(r) for r in got) == brute_shards(rows, 30)


def test_written_shards_fit(spark, tmp_path):
    rows = [(i, "word " * (i % 9)) for i in range(80)]
    sharding.write(frame(spark, rows), str(tmp_path / "out"), limit=200)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    sizes = {}
    for r in back.collect():
        sizes[r.shard_name] = sizes.get(r.shard_name, 0) + len(r.text)
    assert max(sizes.values()) <= 200 and len(sizes) > 5


@pytest.mark.parametrize("limit", [100, 1000])
def test_a_hot_id_splits_until_every_shard_fits(spark, limit):
    rows = [(7, f"text {i} " * 3) for i in range(300)] + [(7, "same text")] * 300 + [(None, f"n {i}") for i in range(200)] + [(i, "cold") for i in range(100, 160)] + [(9, "x" * 5000)]
    got = sharding.assign(frame(spark, rows), limit=limit, split_ids=True).collect()
    assert sorted((r.doc_id or -1, r.n_bytes) for r in got) == sorted((k or -1, len(t.encode())) for k, t in rows)
    shards = {}
    for r in got:
        shards.setdefault((r.local_depth, r.shard), []).append(r)
    for held in shards.values():
        assert {r.shard_bytes for r in held} == {sum(r.n_bytes for r in held)}
        assert held[0].shard_bytes <= limit or len(held) == 1
    # the shards are leaves of one tree, and only buckets over the limit have split
    for depth, shard in shards:
        assert not any((d, shard >> (depth - d)) in shards for d in range(depth))
    sizes = {}
    for (depth, shard), held in shards.items():
        for d in range(depth):
            sizes[d, shard >> (depth - d)] = sizes.get((d, shard >> (depth - d)), 0) + held[0].shard_bytes
    assert all(size > limit for size in sizes.values())


def test_without_hot_ids_splitting_changes_nothing(spark):
    rows = [(i, "é" * (i * 7 % 50)) for i in range(150)] + [(777, "x" * 5000), (778, None)]
    got = sharding.assign(frame(spark, rows), limit=200, split_ids=True).collect()
    assert sorted(tuple(r) for r in got) == brute_shards(rows, 200)


def test_written_shards_of_a_hot_id_fit(spark, tmp_path):
    rows = [(5, f"words {i}") for i in range(200)] + [(6, "b")]
    sharding.write(frame(spark, rows), str(tmp_path / "out"), limit=200, split_ids=True)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted(rows)
    sizes = {}
    for r in back:
        sizes[r.shard_name] = sizes.get(r.shard_name, 0) + len(r.text)
    assert max(sizes.values()) <= 200


def test_no_rows(spark):
    assert sharding.assign(frame(spark, []), limit=10).collect() == []
    assert mixing.mix(frame(spark, []).withColumn("topic", mixing.topic()), TARGETS).collect() == []


def test_raking_meets_all_margins():
    rng = np.random.default_rng(0)
    table = rng.random((4, 3, 5)) + 0.01
    targets = [rng.random(n) for n in table.shape]
    raked = mixing.rake(table, targets)
    for axis, t in enumerate(targets):
        others = tuple(k for k in range(3) if k != axis)
        assert np.allclose(raked.sum(axis=others), t / t.sum() * table.sum())
    # odds ratios are those of the observed table
    odds = lambda x: x[0, 0, 0] * x[1, 1, 0] / (x[0, 1, 0] * x[1, 0, 0])
    assert odds(raked) == pytest.approx(odds(table))


def test_empty_classes_are_left_out():
    raked = mixing.rake(np.array([[2.0, 0.0], [4.0, 0.0]]), [np.array([1.0, 1.0]), np.array([0.5, 0.5])])
    assert np.allclose(raked, [[3, 0], [3, 0]]) and mixing.rake(np.zeros((2, 2)), [np.ones(2)] * 2).sum() == 0
    with pytest.raises(ValueError):
        mixing.rake(np.array([[1.0, 0.0]]), [np.array([1.0]), np.array([0.0, 1.0])])


def test_sample_has_the_target_shares(spark):
    rows = [(i, "word " * (5 + i % 7), "en" if i % 10 < 8 else "de", f"s{i % 3}", 1) for i in range(6000)]
    df = spark.createDataFrame([*rows, (None, None, None, None, None), (6001, "", "en", "s0", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(df, {"lang": {"en": 0.5, mixing.REST: 0.5}, "source": {"s0": 0.6, "s1": 0.2, "s2": 0.2}}).toPandas()
    assert len(out) == len(rows) + 2 and out["probability"].between(0, 1).all() and out["probability"].max() == 1
    assert not out[out["text"].fillna("") == ""]["taken"].any()
    out["w"] = out["text"].fillna("").str.count(" ") + (out["text"].fillna("") != "")
    expected = out["w"] * out["probability"]
    assert (expected[out["lang"] == "de"].sum() / expected.sum()) == pytest.approx(0.5)
    assert (expected[out["source"] == "s0"].sum() / expected.sum()) == pytest.approx(0.6)
    taken = out[out["taken"]]
    assert (taken["w"][taken["source"] == "s0"].sum() / taken["w"].sum()) == pytest.approx(0.6, abs=0.04)


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_id_are_drawn_one_by_one(spark, key, copies):
    rows = [(key, "same" if copies else f"t{i}", "a" if i < 1000 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"source": {"a": 0.5, "b": 0.5}}).toPandas()
    assert len(out) == 3000
    assert out["taken"][out["source"] == "a"].all() and out["taken"][out["source"] == "b"].mean() == pytest.approx(0.5, abs=0.05)


def test_tempered_power_one_takes_all(spark):
    df = spark.createDataFrame([(i, "a b c", f"s{i % 5}") for i in range(50)], "doc_id long, text string, source string")
    out = mixing.mix(df, {"source": mixing.Tempered(("s0", "s1"), 1.0)}).collect()
    assert all(r.taken and r.probability == pytest.approx(1) for r in out)


def test_topics(spark):
    texts = {"": "empty", None: "empty", "plain words here.": "prose", "a | b | c": "table", "a&&& b%%% c$$$": "marked", "LOUD WORDS": "shouted"}
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("topic", mixing.topic())
    assert {r.text: r.topic for r in df.collect()} == texts


SF = "/root/testdata/sf0.001"


def plain_raking(cells, weights, shares):
    """Raked weight of each cell by scaling one margin after the other, with dictionaries."""
    table = dict(weights)
    total = sum(table.values())
    for _ in range(3000):
        for axis, wanted in enumerate(shares):
            have = {}
            for cell, w in table.items():
                have[cell[axis]] = have.get(cell[axis], 0) + w
            table = {cell: w * wanted[cell[axis]] * total / have[cell[axis]] for cell, w in table.items()}
    return table


def test_registered_mixture_equals_plain_raking(spark):
    import base64

    import public_tokenizers
    import tiktoken
    import xxhash

    from rasterspark.llm.queries import queries

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op6_mixture"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    weights = {}
    for r in rows:
        assert (r.source, r.lang) == (docs[r.doc_id].source, docs[r.doc_id].lang)
        assert r.tokens == len(library.encode_ordinary(docs[r.doc_id].text or ""))
        cell = (r.source or "*", r.lang or "*", r.topic)
        weights[cell] = weights.get(cell, 0) + r.tokens
    weights = {c: w for c, w in weights.items() if w}
    shares = []
    for axis, target in enumerate(TARGETS.values()):
        have = {}
        for cell, w in weights.items():
            have[cell[axis]] = have.get(cell[axis], 0) + w
        total = sum(w**target.power for w in have.values())
        shares.append({k: w**target.power / total for k, w in have.items()})
    raked = plain_raking(None, weights, shares)
    ratio = {c: raked[c] / weights[c] for c in weights}
    spent, total = 0, sum(raked.values())
    for cell in sorted(ratio, key=lambda c: -ratio[c]):  # cells of the largest ratios with 1 % of the weight are taken whole
        spent += raked[cell]
        top = ratio[cell]
        if spent > 0.01 * total:
            break
    assert sum(r.taken for r in rows) > 0.6 * len(rows)
    unsigned = (1 << 64) - 1
    for r in rows:
        want = min(1, ratio[r.source or "*", r.lang or "*", r.topic] / top) if r.tokens else 0
        assert r.probability == pytest.approx(want, abs=1e-9)
        h = xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42)
        digest = xxhash.xxh64_intdigest(docs[r.doc_id].text.encode(), 42) if docs[r.doc_id].text is not None else 42
        h = xxhash.xxh64_intdigest((digest & unsigned).to_bytes(8, "little"), h)
        h = xxhash.xxh64_intdigest((0).to_bytes(4, "little"), h)
        assert r.taken == ((h >> 11) / (1 << 53) < r.probability)
    assert {r.topic for r in rows} > {"t0"} or len({r.topic for r in rows}) > 2


def test_topics_are_those_of_plain_clustering(spark):
    rng = np.random.default_rng(5)
    groups = rng.integers(0, 3, 240)
    counts = np.zeros((240, mixing.WIDTH))
    for row, g in zip(counts, groups, strict=True):
        np.add.at(row, rng.integers(20 * g, 20 * g + 18, 80), 1)
    profiles = np.sqrt(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([([float(x) for x in p],) for p in [*profiles, np.zeros(mixing.WIDTH)]], "profile array<float>").repartition(5)
    got = mixing.learn_topics(df, topics=4, rounds=4)
    centres = np.abs(np.random.default_rng(0).normal(size=(4, mixing.WIDTH)))
    centres /= np.sqrt((centres**2).sum(axis=1, keepdims=True))
    for _ in range(4):
        at = (profiles.astype(float) @ centres.T).argmax(axis=1)
        for k in range(4):
            total = profiles[at == k].astype(float).sum(axis=0)
            centres[k] = total / np.sqrt((total**2).sum()) if total.any() else centres[k]
    assert np.allclose(got, centres, atol=1e-6)
    names = [r.t for r in df.select(mixing.topic_of(got).alias("t")).collect()]
    assert names.count("empty") == 1 and set(names) <= {"t0", "t1", "t2", "t3", "empty"}
    assert np.allclose(mixing.learn_topics(df.limit(0), topics=4, rounds=2), np.round(np.abs(np.random.default_rng(0).normal(size=(4, mixing.WIDTH))) / np.sqrt((np.random.default_rng(0).normal(size=(4, mixing.WIDTH)) ** 2).sum(axis=1, keepdims=True)), 9))


def test_classes_come_from_the_data(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CLASSES", 2)
    rows = [(i, "a b c", s) for i, s in enumerate(["x"] * 6 + ["y"] * 4 + ["z"] * 2 + [None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.resolved(df, {"source": mixing.Tempered(None, 0.5)}, mixing.tokens())
    assert found["source"] == mixing.Tempered(("x", "y"), 0.5)
    out = mixing.mix(df, {"source": mixing.Tempered(None, 0.0)}).toPandas()
    probability = out.groupby(out["source"].fillna("-"))["probability"].max()
    assert probability["z"] == 1 and probability["-"] == 1  # one class of three rows
    assert probability["x"] == pytest.approx(0.5) and probability["y"] == pytest.approx(0.75)


def test_a_class_of_few_documents_does_not_thin_out_all_others(spark):
    rows = [(i, "word " * 9, "big") for i in range(3000)] + [(i, "word " * 9, f"s{i % 4}") for i in range(3000, 4000)] + [(9000, "word " * 9, "rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, {"source": mixing.Tempered(None, 0.9)}).toPandas()
    assert out["probability"][out["source"] == "rare"].iloc[0] == 1 and out["probability"][out["source"] == "s0"].iloc[0] == 1
    assert out["probability"][out["source"] == "big"].iloc[0] == pytest.approx((3000 / 250) ** -0.1)
    raked, observed = np.array([[0.0, 2.0], [100.0, 898.0]]), np.array([[0.0, 1.0], [80.0, 919.0]])
    assert mixing.chances(raked, observed)[0, 1] == 1 and mixing.chances(raked, observed)[1, 0] == 1
    assert mixing.chances(raked, observed, 0.0)[1, 0] == pytest.approx(1.25 / 2)
    assert not mixing.chances(np.zeros((2, 2)), np.zeros((2, 2))).any()


def test_classes_of_a_computed_column_are_computed_once(spark, tmp_path):
    """A second computation in a task would run in a Python worker of its own."""
    seen = tmp_path / "seen"

    @arrow_udf("string")
    def kind(column: pa.Array) -> pa.Array:
        with seen.open("a") as f:
            f.write(f"{len(column)}\n")
        return pa.array([None if x % 7 == 0 else f"k{x % 70}" for x in column.to_pylist()])

    rows = spark.range(0, 700, 1, 2).select(kind("id").alias("kind"), F.lit(1).alias("w"))
    found = mixing.resolved(rows, {"kind": mixing.Tempered(None, 1.0)}, F.col("w"))["kind"].values
    assert sum(map(int, seen.read_text().split())) == 700
    assert set(found) == {f"k{x}" for x in range(70) if x % 7}


def test_the_null_class_takes_no_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CLASSES", 2)
    rows = spark.createDataFrame([(None, 9), ("a", 1), ("b", 5), ("c", 3)], "kind string, w int")
    assert mixing.resolved(rows, {"kind": mixing.Tempered(None, 1.0)}, F.col("w"))["kind"].values == ("b", "c")


def test_cells_need_no_python_workers(spark):
    rows = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2), ('*', 0) AS t(c, w)")
    cells = mixing.calibrate(rows, ["c"], {"x": {"a": 0.5, "b": 0.5}})
    assert "ExistingRDD" not in cells._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in cells.orderBy("c").collect()] == [("a", 1.0, 1.5, 1.0), ("b", 2.0, 1.5, 0.5)]
    none = mixing.calibrate(rows.limit(0), ["c"], {"x": {"a": 0.5, "b": 0.5}})
    assert none.count() == 0 and none.columns == cells.columns
