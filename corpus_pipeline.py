"""Stages that turn ``documents`` into training data; each one's rows are written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, decontaminate, quality_rules, queries, simhash, substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the rules or come from a rejected host go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays, the one with the smallest id; null ids come last."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that also start earlier are taken out of the text."""
    return substring_dedup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item of ``benchmark`` go, each by its own text."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``token_ids`` and the decoded text of every row."""
    coded = bpe.encode_decode(docs, queries.vocabulary())
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontamination),
    ("bpe_encoding", encoding),
]
#: SQL has no fingerprints by majority of bits, no alignment and no byte-pair encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return docs
