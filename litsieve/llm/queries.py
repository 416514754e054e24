"""One query for each corpus operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontamination, hash_forest, language_id, license_scan, near_dedup, substring_dedup, suffix_dedup, token_counts, token_files
from .oracles import ORACLES
from .shared import documents


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_files.write_blocks(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_documents(blocks)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), size=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir)).drop("kept", "rid")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_windows(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_token_files, op3_token_counts, op4_suffix_dedup, op5_near_dedup, op6_substring_dedup, op7_decontamination, op8_hash_forest, op9_byte_bpe, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
