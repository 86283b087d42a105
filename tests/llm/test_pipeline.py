"""The pipeline's stages, one after the other, on whole tables."""

import hashlib

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from rasterspark.llm import langid, quality
from tests.llm.test_neardup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("steps") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_every_stage_works_on_what_its_predecessor_kept(spark, steps):
    source = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    columns = list(next(iter(source.values())))
    assert all(s.columns == columns for s in steps[:-1])
    for step in steps[:-1]:
        assert all(r.asDict() == source[r.doc_id] for r in step.collect())
    sizes = [len(source), *(s.count() for s in steps)]
    assert sizes == sorted(sizes, reverse=True) and sizes[4] == sizes[5] > 0


def test_language_and_quality_keep_clean_documents(spark, steps):
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        lang, margin = model.predict(r["text"])
        assert (r["doc_id"] in ids(steps[0])) == (lang != "und" and margin >= langid.MIN_MARGIN)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    before, after = set(ids(steps[0])), set(ids(steps[1]))
    assert all(i in after for i in before if labels.get(i) == 1)
    assert sum(i in after for i in before if labels.get(i) == 0) <= 1


def test_one_document_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {c for _, _, c in brute(rows, 5, 80)}
    assert set(ids(steps[2])) == want and len(ids(steps[2])) == len(want)


def test_ids_decode_to_the_texts(steps):
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    rows = steps[4].collect()
    assert len(rows) == len(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.token_ids) for r in rows)


def test_run_equals_the_stages(spark, steps):
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.decoded_sha256) for r in out.collect()) == sorted((r.doc_id, r.decoded_sha256) for r in steps[4].collect())


def test_odd_rows_pass_through(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, accepted string, probability string"
    rows = [(1, "some english words for the test", "en", "s", 3, "a", "b"), (None, "some other english words here", "en", None, None, None, None), (2, None, None, None, None, None, None), (3, "", "en", "s", 0, "a", "b"), (1, "some english words for the test", "en", "s", 3, "a", "b"), (4, "long words " * 30_000, "en", "s", 3, "a", "b")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{len(given)}")
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "byte_level_bpe":
                assert docs.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
                assert {r.accepted for r in docs.collect()} <= {"a", None}
        assert (docs.count() > 0) == bool(given)
