"""The queries over ``documents`` and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"), keep_columns=False)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens, with_limit

    return with_limit(count_tokens(_table(spark, sf_dir, "documents"), vocabulary()))


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests, encode_decode

    return digests(encode_decode(_table(spark, sf_dir, "documents"), vocabulary()))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import classes

    found = classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_qgram_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup, digests

    return digests(dedup(_table(spark, sf_dir, "documents")))


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup, digests

    return digests(dedup(_table(spark, sf_dir, "documents")))


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score

    return score(_table(spark, sf_dir, "documents"))


def op2_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_event_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(_table(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_automaton_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import digests, transform

    return digests(transform(_table(spark, sf_dir, "documents")))


def op13_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import records
    from .common import new_path, shuffles_dropped

    vocabulary_file, path = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "records")
    with shuffles_dropped(spark):
        records.write(records.encode(_table(spark, sf_dir, "documents"), vocabulary_file), path, records.width_of(vocabulary_file))
    return records.read(spark, path, ["doc_id", "start", "n_tokens", "ids_crc32"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_index": oracle.SUBSTRINGS, "op5_host_rules": oracle.HOST_RULES, "op12_automaton_scan": oracle.FILL_IN_MIDDLE}
