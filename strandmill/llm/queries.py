"""The registered queries of this package: one thin query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandmill.llm import bpe, imatch, langid, lines, minhash, mixing, neighbours, quality, records, substring


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op2_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 100 == 0)


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(_documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir), with_text=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_digest(_documents(spark, sf_dir))


def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).drop("copies")


def _tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_documents(spark, sf_dir), _tokenizer(), full=False)


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(_documents(spark, sf_dir), _tokenizer())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_held_out(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_hilbert_neighbours": op2_hilbert_neighbours,
    "op3_imatch_fingerprints": op3_imatch_fingerprints,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_resampling": op6_quality_resampling,
    "op7_mix_sources": op7_mix_sources,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_token_records": op9_token_records,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": lines.ORACLE,
    "op7_mix_sources": mixing.ORACLE,
}
