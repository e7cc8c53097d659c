"""Corpus pipeline: five operators in a row, each written as a table and read again.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and all but the last return the columns of ``documents``.  Every
stage takes null ids, texts and sources, empty and very long texts, repeated
rows, further columns and empty tables; what becomes of them stands in the
docstring of the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontaminate, simhash, source_mix, token_shards, toxicity
from corvane.llm.staging import discard, new_path, owned, scratch, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; rows without words, or with a null text, stay, and a null id changes nothing."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more) stays.

    Texts without words are one group; of a group the row with the smallest id stays, without ids any one.
    """
    return simhash.keep_one(docs, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go; each row is judged by its own text, so rows without words stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights; null is a source of its own."""
    return source_mix.mix(docs)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in training order as binary shards; a row per sequence of the written shards, with its documents.

    The shards go to a new folder in that of ``spark.corvane.shards``, where
    they stay; without this setting they are removed with the session.  Texts
    without tokens give an end token alone, an empty table no sequence.
    """
    kept = spark.conf.get("spark.corvane.shards", None)
    path = new_path(spark, "token-shards")
    path = f"{kept.rstrip('/')}/{path.rpartition('/')[2]}" if kept else owned(spark, path, lasting=True)
    token_shards.write_shards(docs, path)
    return token_shards.shard_report(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_shards", write_token_shards),
]

#: SimHash, the toxicity model and tokenisation have no SQL form; tests hold run() against a plain model of the five stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage stages, and the table it reads, go when its result is written.

    Tables that other queries of the session have staged stay.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for nth, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            made = staged(stage(spark, docs, sf_dir), name, lasting=True)
        if nth:
            discard(spark, docs)
        docs = made
    return docs
