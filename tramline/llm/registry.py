"""The queries of the training-text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import suffix_dedup, wu_manber
from tramline.llm.crf import labelled
from tramline.llm.lc_parse import fingerprints
from tramline.llm.minhash import near_duplicates
from tramline.llm.quality import quality_scores
from tramline.llm.secrets import scanned
from tramline.llm.sp_codec import encoded
from tramline.llm.token_rollup import rolled
from tramline.llm.tool_chat import formatted


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(_table(spark, sf_dir, "documents"))


def op10_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_token_rollup, op4_minhash, op5_quality, op6_suffix_dedup, op7_decontamination, op8_fingerprints, op9_secrets, op10_tool_chat)}


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_dedup": suffix_dedup.sql(), "op7_decontamination": wu_manber.sql()}
