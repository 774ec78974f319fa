"""Constraint reports: rules that a table should hold, with the rows that break them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_report(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, rows, broken): one pass for all rules; a null outcome holds, as in SQL."""
    broken = [F.count_if(~F.coalesce(rule, F.lit(True))).alias(name) for name, rule in rules.items()]
    one = df.agg(F.count("*").alias("_rows"), *broken)
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in rules])
    return one.select(F.lit(table).alias("table"), F.col("_rows").alias("rows"), F.explode(pairs).alias("x")).select("table", "x.rule", "rows", "x.broken")


def key_report(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    repeats = df.groupBy(*keys).agg((F.count("*") - 1).alias("_more"))
    return repeats.agg(F.lit(table).alias("table"), F.lit("unique(" + ",".join(keys) + ")").alias("rule"), F.coalesce(F.sum(F.col("_more") + 1), F.lit(0)).alias("rows"), F.coalesce(F.sum("_more"), F.lit(0)).alias("broken"))


def reference_report(df: DataFrame, table: str, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """Rows whose reference is in no row of the other table."""
    known = other.select(F.col(other_key).alias(key)).distinct().withColumn("_known", F.lit(True))
    joined = df.select(key).join(known, key, "left")
    return joined.agg(F.lit(table).alias("table"), F.lit(f"{key} in {other_key}").alias("rule"), F.count("*").alias("rows"), F.count_if(F.col(key).isNotNull() & F.col("_known").isNull()).alias("broken"))


def single_pick(df: DataFrame, group: Sequence[str], pick: str) -> DataFrame:
    """Groups with more than one pick; empty when picks are free of contradiction."""
    return df.groupBy(*group).agg(F.count_if(F.col(pick)).alias("picks")).where("picks > 1")
