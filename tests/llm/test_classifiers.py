"""Language and quality: held-out accuracy, edge cases, and the flattened trees against a plain walk."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rasterspark.llm import langid, quality
from rasterspark.llm.queries import queries
from rasterspark.llm.textbytes import flat

SF = "/root/testdata/sf0.01"


def column(name, *columns):
    table = pq.read_table(f"{SF}/{name}.parquet")
    return list(zip(*(table[c].to_pylist() for c in columns), strict=True))


def test_language_held_out_accuracy(spark):
    truth = dict(column("documents", "doc_id", "lang"))
    rows = queries()["op7_language"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and np.mean([r.accepted for r in rows]) > 0.99


def test_language_edge_cases(spark):
    schema = "doc_id long, text string, lang string, score string, key int, piece int"
    rows = [(i, "the quick brown fox jumps over the lazy dog " * 3, "en", "s", 1, 1) for i in range(8)]
    rows += [(i + 8, "der schnelle braune fuchs springt über den faulen hund " * 3, "de", "s", 1, 1) for i in range(6)]
    rows += [(20, None, "en", "s", 1, 1), (21, "", "de", "s", 1, 1), (22, "12 !!", None, "s", 1, 1), (None, "the lazy dog and the fox", None, None, None, None), (23, "Über den Hund" * 4000, None, "s", 1, 1), (23, "Über den Hund" * 4000, None, "s", 1, 1)]
    df = spark.createDataFrame(rows, schema)
    model = langid.train(df)
    assert model.langs == ("en", "de")
    out = langid.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "key", "piece", "lang_pred", "score", "accepted"]
    got = {(r.doc_id, r.lang_pred) for r in out.collect()}
    assert {(20, "und"), (21, "und"), (22, "und"), (None, "en"), (23, "de"), (0, "en"), (9, "de")} <= got
    assert out.count() == len(rows)
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).collect() == []


def test_short_texts_are_told_apart(spark):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet").to_pylist()
    short = [r for r in table if 20 < len(r["text"]) < 200]
    got = [model.predict(r["text"]) for r in short]
    assert len(short) > 200 and np.mean([g == r["lang"] for (g, _), r in zip(got, short, strict=True)]) > 0.95
    assert np.mean([m >= langid.MIN_MARGIN for _, m in got]) > 0.97


def test_narrow_margins_are_rejected(spark):
    model = langid.Model(("a", "b"), (b"same dictionary " * 9, b"same dictionary " * 9))
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    row = langid.predict(df, model).first()
    assert (row.lang_pred, row.score, row.accepted) == ("a", 0.0, False)


def test_quality_held_out(spark):
    truth = dict(column("labels", "doc_id", "quality"))
    rows = queries()["op10_quality"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for (i,) in column("documents", "doc_id"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "One two. Two!!\nthree | four", " ", "\n\n", "É" * 3000, "word " * 2000, "a"]
    data, offsets = flat(pa.array(texts))
    together = quality.statistics(data, offsets)
    for i, t in enumerate(texts):
        alone = quality.statistics(*flat(pa.array([t])))
        assert np.allclose(together[i], alone[0])
    assert not together[0].any() and together.shape[1] == len(quality.STATISTICS) and np.isfinite(together).all()


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x, y, trees=20, depth=3)
    got = forest.score(x)
    for row, s in zip(x[:50], got, strict=False):
        total = forest.base
        for root in forest.roots:
            at = root
            while forest.left[at] != at:
                at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        assert s == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == y).mean() > 0.95


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, "A good text.", "x"), (2, None, "x"), (None, "no id", "x"), (1, "A good text.", "x"), (3, "", "x")], "doc_id long, text string, stats string")
    measured = quality.measure(docs)
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    one_class = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int")
    for labels, low, high in ((none, 0.5, 0.5), (one_class, 0.6, 1)):
        rows = quality.score(measured, quality.train(measured, labels)).collect()
        assert len(rows) == 5 and all(low <= r.score <= high for r in rows)
    assert quality.score(measured.limit(0), quality.train(measured, none)).collect() == []


def test_language_sample_is_bounded_and_whole(spark):
    hot = [(1, "the same english text, a third of all rows and more", "en")] * 3000
    rows = hot + [(1, f"english words number {'abcdefghij'[i % 10] * (1 + i // 10)}", "en") for i in range(200)] + [(None, "ein", "de"), (2, "12 34", "xx"), (3, "long start " * 2000 + "zebra finish", "fr")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=16)
    assert model.langs == ("en", "de", "fr")  # one short line is a language too; no letter teaches nothing
    by = dict(zip(model.langs, model.dictionaries, strict=True))
    assert by["en"].count(b"english") <= 16 and by["en"].count(b"third of all") <= 1
    assert by["fr"].endswith(b"zebra finish") and by["de"].startswith(b"ein ")
    assert model.predict("long start zebra finish")[0] == "fr"


def test_one_measure_for_all_lengths():
    model = langid.Model(("a", "b"), (b"alpha beta gamma delta " * 9, b"one two three four five " * 9))
    for n in (1, 3, 20, 400):
        data = langid.normalise("gamma delta alpha " * n)
        blocks = [data[i : i + model.block] for i in range(0, len(data), model.block)]
        assert model.sizes(data) == [sum(s) for s in zip(*(model.sizes(b) for b in blocks), strict=True)]
        assert model.predict("gamma delta alpha " * n)[0] == "a"


def test_the_whole_text_counts():
    model = langid.Model(("a", "b"), (b"alpha beta gamma delta epsilon zeta " * 40, b"uno dos tres cuatro cinco seis siete " * 40))
    head, tail = "alpha beta gamma delta epsilon zeta " * 50, "uno dos tres cuatro cinco seis siete " * 50
    assert model.predict(head)[0] == "a" and model.predict(head + "xq jw vk zp " * 3 + tail * 40)[0] == "b"


def test_kept_rows_are_the_accepted_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    want = sorted(r.doc_id for r in langid.predict(docs, model, keep=["doc_id"]).where("accepted").collect())
    out = langid.keep(docs, model)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.select("doc_id").collect()) == want


def test_language_predictions_equal_a_plain_recount(spark):
    """The registered query against sizes of whole frames, one compressor call for each block and language."""
    import zstandard

    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    texts = dict(column("documents", "doc_id", "text"))
    for r in queries()["op7_language"](spark, SF).orderBy("doc_id").limit(60).collect():
        data = langid.normalise(texts[r.doc_id])
        costs = []
        for raw in model.dictionaries:
            size = max(15, (len(raw) + langid.BLOCK).bit_length())
            how = zstandard.ZstdCompressionParameters(window_log=size, hash_log=min(size, 20), chain_log=min(size, 20), search_log=langid.SEARCH, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=how)
            costs.append(sum(len(zstandard.ZstdCompressor(dict_data=own, compression_params=how).compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)))
        order = sorted(range(len(costs)), key=lambda k: (costs[k], k))
        assert (r.lang_pred, r.score) == (model.langs[order[0]], 1.0 - costs[order[0]] / costs[order[1]])


def test_quality_sample_is_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(1, f"Good sentence {i}, with words.") for i in range(2000)] + [(i, "BAD!!! $$$ " * 9) for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)] * 2000 + [(1, 0, 0)] + [(i, 0, 0) for i in range(2, 40)], "doc_id long, quality int, toxic int")
    taught = quality._sample(labels, "doc_id", "quality", 10).collect()
    assert len(taught) == 10 and len({r.doc_id for r in taught}) == 10
    assert {r.label for r in quality._sample(labels, "doc_id", "quality", 1000).where("doc_id = 1").collect()} == {1}
    forest = quality.fit(docs, labels, sample_rows=100)
    again = quality.train(quality.measure(docs), labels, sample_rows=100)
    x = quality.statistics(*flat(pa.array(["Good sentence 5, with words.", "BAD!!! $$$ "])))
    assert np.array_equal(forest.score(x), again.score(x))


def test_boosting_equals_a_plain_first_tree():
    """The root split and the leaves of one stump against all splits tried one by one."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)).astype(np.float32)
    y = (x[:, 1] + 0.3 * rng.normal(size=120) > 0.2).astype(float)
    forest = quality.grow(x, y, trees=1, depth=1, bins=64, rate=1.0)
    p = 1 / (1 + np.exp(-forest.base))
    grad, hess = p - y, np.full(120, p * (1 - p))
    score = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
    best = max(score(x[:, j] <= t) + score(x[:, j] > t) for j in range(3) for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 64)[1:-1], method="lower")) if hess[x[:, j] <= t].sum() >= 1 and hess[x[:, j] > t].sum() >= 1)
    root = forest.roots[0]
    left = x[:, forest.feature[root]] <= forest.threshold[root]
    assert score(left) + score(~left) == pytest.approx(best)
    assert forest.value[forest.left[root]] == pytest.approx(-grad[left].sum() / (hess[left].sum() + 1)) and forest.value[forest.right[root]] == pytest.approx(-grad[~left].sum() / (hess[~left].sum() + 1))


def test_registered_quality_equals_a_plain_walk(spark):
    texts, labels = dict(column("documents", "doc_id", "text")), spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taught = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    forest = quality.fit(docs, taught)
    for r in queries()["op10_quality"](spark, SF).orderBy("doc_id").limit(50).collect():
        x = quality.statistics(*flat(pa.array([texts[r.doc_id]])))[0]
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
            total += forest.value[at]
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
