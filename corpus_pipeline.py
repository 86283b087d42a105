"""A corpus pipeline over `documents`: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from rasterspark.llm import bpe, langid, neardup, quality
from rasterspark.llm.queries import documents, mixed
from rasterspark.session import Scratch, prepare, released

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _prepared(stage: Stage) -> Stage:
    """A stage that may be called by itself: workers find this package and hold batches of bounded size."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark), docs, sf_dir)

    return run


@_prepared
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a sufficient margin stay; the model learns from `lang`."""
    return langid.keep(docs, langid.train(docs))


@_prepared
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1 stay; it learns from `labels`.

    Documents with null or repeated ids are judged by their own text.
    """
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_prepared
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return neardup.deduplicate(docs, size=5, percent=80)


@_prepared
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that their tokens have the target shares of source, language and topic."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # so that added columns clash with none
    rows = docs.select(whole, "doc_id", "source", "lang", "text")
    return mixed(Scratch(spark, "stage-mixture"), rows).where("taken").select("row.*")


@_prepared
def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the digest of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kept = ["doc_id", "lang", "source", "n_chars"]
    out = bpe.encode(docs, ranks, keep=kept, decoded="decoded_sha256")
    return out.select(*kept, F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("byte_level_bpe", byte_level_bpe),
]

#: Compression, boosted trees and byte-level merges are beyond SQL; the stages are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each stage's rows are written to the shared folder and reread.

    What a stage wrote for itself, and the rows of the stage before it, are removed when its rows are written.
    """
    prepare(spark)
    scratch, before = Scratch(spark, "pipeline"), None
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with released():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
