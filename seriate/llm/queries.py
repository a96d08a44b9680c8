"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, lines, media, mixing, neardup, pii, sharding, substrings, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3(table(spark, sf_dir, "documents"))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5(table(spark, sf_dir, "documents"))


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"), lines.Params(short=True))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op7(table(spark, sf_dir, "documents"))


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_toxicity, op2_substring_dedup, op3_pii_pseudonyms, op4_jpeg_media, op5_mixing, op6_fuzzy_lines, op7_language_id, op8_minhash_neardup, op9_sharding, op10_decontamination]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substrings.SQL, "op8_minhash_neardup": neardup.SQL, "op9_sharding": sharding.SQL.format(docs="documents")}
