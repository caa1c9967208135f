"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import contamination, language_crf, license_scan, line_dedup, ngram_join, packing, passages, personal_data, quality_rules, shard_tree
from .sql import ORACLE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.digest(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(table(spark, sf_dir, "documents"))


def op6_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.assign_shards(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policy versions costs, from one stored ledger."""
    return quality_rules.compare_policies(quality_rules.store_ledger(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_language_crf, op2_ngram_join, op3_license_scan, op4_substring_dedup, op5_personal_data,
        op6_shard_tree, op7_best_fit_packing, op8_line_dedup, op9_quality_rules, op10_decontamination, quality_ablations,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
