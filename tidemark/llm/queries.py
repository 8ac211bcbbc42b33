"""Registered queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, ann, bpe, decontam, html_extract, langid, lm_score, minhash, prefix_trie, sharding, suffix_dedup, token_counts, toxicity
from tidemark.llm.common import tables
from tidemark.llm.oracles import ORACLES


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, = tables(spark, sf_dir, "documents")
    return bpe.token_digests(docs)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_near_duplicates": minhash.query,
    "op3_language": langid.query,
    "op4_toxicity": toxicity.query,
    "op5_token_counts": token_counts.query,
    "op6_neighbours": ann.query,
    "op7_repeats": suffix_dedup.query,
    "op8_decontaminate": decontam.query,
    "op9_cross_entropy": lm_score.query,
    "op10_html": html_extract.query,
    "op11_sharding": sharding.query,
    "op12_alignment": alignment.query,
    "op13_prefix_trie": prefix_trie.query,
}

__all__ = ["ORACLES", "QUERIES"]
