"""A training corpus in four stages: quality, near-duplicates, shared passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it keeps,
with the columns of ``documents``; the last returns a place for every document left.
``run`` writes each stage as Parquet in the shared folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumage.llm import packing, quality, simhash, substring
from plumage.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_filter(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return simhash.deduplicated(docs)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has."""
    return substring.without_passages(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document."""
    return packing.packed(packing.word_lengths(docs), ["doc_id", "n_tokens"], "n_tokens")


STAGES = [("quality rules", quality_stage), ("SimHash near-dedup", near_duplicate_stage), ("substring dedup", passage_stage), ("packing", packing_stage)]

#: Fingerprints, seeds and chains are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
