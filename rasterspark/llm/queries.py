"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from rasterspark.llm import bpe, htmltext, langid, mixing, neardup, neighbours, quality, sharding, threshold, tokenfile
from rasterspark.session import Scratch

#: Byte limit of a shard.
SHARD_BYTES = 1 << 20
#: Powers that flatten the shares of tokens of sources, languages and topics; the classes come from the data.
TARGETS = {name: mixing.Tempered(None, 0.95) for name in ("source", "lang", "topic")}


def dealt(df: DataFrame) -> DataFrame:
    """A table as it is read, its rows dealt out to all cores if it has fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _fold(n: int):
    """crc32 of the id as text, modulo n; a null id is in no fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard, offset) of every document, read back from token files with an end id 2; a null text has its end id only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokenfile.round_trip(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document by 3-word shingles at 85 %; a text without words is linked with nothing, a null id has a null component."""
    return neardup.components(documents(spark, sf_dir), size=3, percent=85)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a null or empty page has an empty text."""
    return htmltext.extract_pages(dealt(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op4_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ten largest integer inner products of every 100th id; bad vectors take no part."""
    return threshold.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), repeats=True)


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, local_depth, shard, shard_bytes) of every document at SHARD_BYTES a shard; only a single larger row exceeds it."""
    return sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), limit=SHARD_BYTES, split_ids=True)


def mixed(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """Rows (with doc_id, source, lang and text) without their text but with topic, tokens, probability and taken.

    The text is encoded once, for its tokens and its topic.
    """
    counts = mixing.counted(public_tokenizers.path("byte_bpe_50k.json")).alias("counts")
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "text"]
    written = scratch.table(rows.select(*kept, F.xxhash64("text").alias("digest"), counts).select("*", "counts.*").drop("counts"), "counted")
    classed = written.withColumn("topic", mixing.topic_of(mixing.learn_topics(written))).drop("profile")
    return mixing.mix(classed, TARGETS, weight=F.col("tokens"), digest=F.col("digest")).drop("digest")


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, taken) of every document; one without tokens has probability 0."""
    out = mixed(Scratch(spark, "mixture"), documents(spark, sf_dir).select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", "probability", "taken")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every document, learned outside the held-out fold; `und` without a letter. A null id is in no fold and teaches nothing."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.train(docs.where(_fold(3) != 1))
    held_out = F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out")
    return langid.predict(docs, model, keep=["doc_id"]).select("doc_id", held_out, "lang_pred", "score", "accepted")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the five largest cosines of every 50th id; zero and bad vectors take no part."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), repeats=True)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, exact) of every document; a null text is empty."""
    return bpe.digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned outside the held-out fold; a null text is empty."""
    docs = documents(spark, sf_dir)
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(_fold(5) != 0))
    held_out = F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out")
    return quality.score(quality.measure(docs), forest).select("doc_id", held_out, "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_token_file, op2_near_duplicates, op3_html_text, op4_threshold_top_k, op5_shards, op6_mixture, op7_language, op8_neighbours, op9_bpe, op10_quality)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL states in full; the others are tested against brute force."""
    return {"op2_near_duplicates": neardup.oracle(3, 85), "op4_threshold_top_k": threshold.ORACLE, "op5_shards": sharding.oracle(SHARD_BYTES), "op8_neighbours": neighbours.ORACLE}
