"""The corpus operators as registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir))


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import retrieval_packing

    return retrieval_packing(_documents(spark, sf_dir))


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity_scores

    return toxicity_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.word_pieces import token_counts

    return token_counts(_documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mixing_plan

    return mixing_plan(_documents(spark, sf_dir)).drop("copies", "source")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_components

    return simhash_components(_documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_files import token_table

    return token_table(_documents(spark, sf_dir))


def op9_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import secret_spans

    return secret_spans(_documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality_scores

    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import source_divergence

    return source_divergence(_documents(spark, sf_dir))


def op12_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substrings import repeat_digests

    return repeat_digests(_documents(spark, sf_dir))


def op13_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.collocations import collocations

    return collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import collocations, divergence, embedding_dedup, mixing, substrings

    return {
        "op6_source_mixing": mixing.ORACLE,
        "op3_pivot_permutation": embedding_dedup.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_fixed_block_anchors": substrings.ORACLE,
        "op13_phrase_tries": collocations.ORACLE,
        "op1_exact_dedup": """
            WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
                 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
            FROM d JOIN g USING (t)
        """,
    }
