"""The corpus pipeline: documents of good quality, without copies, mixed to weights and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows
as Parquet to the shared folder and reads them back as the next one's docs; a stage's rows are
deleted once those of the next are written. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, packing, quality, simhash
from tessera.llm.base import discard, materialise


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labels of documents in docs."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return exact_dedup.keep_one_of_each(docs)


def distinct_prints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one with the smallest doc_id."""
    return simhash.keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.retrieval_packing(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_prints),
    ("source_mixing", mixed),
    ("packing", packed),
]

#: No SQL equals the learned quality stage or the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the result is the last stage's rows."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
