"""Queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import interpolation, language_crf, line_dedup, mixing, packing, permutation_index, quality_rules, simhash, tokenfile, weak_quality
from ._common import table


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op5_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.identify(table(spark, sf_dir, "documents"))


def op8_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(table(spark, sf_dir, "embeddings"))


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents")).select("doc_id", "weak_label", "score", "kept")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.encode_table(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_interpolation": op5_interpolation,
    "op6_language_crf": op6_language_crf,
    "op8_permutation_index": op8_permutation_index,
    "op7_weak_quality": op7_weak_quality,
    "op9_token_file": op9_token_file,
    "op10_mixing": op10_mixing,
}

ORACLES = {
    "op2_quality_rules": quality_rules.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
