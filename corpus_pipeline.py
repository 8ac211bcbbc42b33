"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, token ids.

``STAGES`` lists the steps in order.  Each takes (spark, docs, sf_dir) and
returns a frame; ``run`` writes each result as Parquet in the shared checkpoint
folder and reads it again for the next step.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontam, minhash, suffix_dedup, toxicity
from tidemark.session import stored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model of the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.learn(docs, toxicity.training_labels(labels)))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return minhash.without_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, less the passages of 50 bytes and more that an earlier one has.

    Only letters of which every byte goes are cut, so texts stay texts; a
    document that is nothing but repeats stays with an empty text.
    """
    return suffix_dedup.without_repeats(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no run of words of a benchmark item occurs."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids and digests of ids and decoded text of every document left."""
    return bpe.token_digests(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("MinHash near-dedup", without_near_duplicates),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", token_ids),
]

ORACLE_SQL = None  # the stages cannot be put as SQL; tests/llm holds them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
