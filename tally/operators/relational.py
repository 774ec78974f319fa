"""Joins, picks and pages that recur in every query."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_rn") -> DataFrame:
    """One row a key, first in a total order; a rank window that Catalyst limits before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)


def left_join_best(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Left join to the best right row of each key."""
    return left.join(first_per_key(right, keys, order), list(keys), "left")


def left_join_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join to the last right row of each key."""
    return left_join_best(left, right, keys, [F.col(c).desc_nulls_last() for c in order])


def exists_flag(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A boolean column: whether a right row with the keys exists (usable inside OR)."""
    marks = right.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return left.join(marks, list(keys), "left").withColumn(name, F.col("_hit").isNotNull()).drop("_hit")


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """NOT IN with its null rules: a null on the right keeps nothing, a null on the left is dropped unless the right is empty.

    The right side is looked at once for nulls and rows; the rest is a plain anti join.
    """
    facts = right.agg(F.count("*").alias("n"), F.count_if(F.col(right_key).isNull()).alias("nulls")).first()
    if facts["nulls"]:
        return left.limit(0)
    if not facts["n"]:
        return left
    keys = right.select(F.col(right_key).alias(left_key)).distinct()
    return left.where(F.col(left_key).isNotNull()).join(keys, left_key, "left_anti").select(left.columns)


def page(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0, cap: int = 1000) -> DataFrame:
    """One page in a total order, as a top-k without a full sort."""
    return df.orderBy(*order).offset(offset).limit(max(0, min(limit, cap)))


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    return page(df, order, limit, offset), df.agg(F.count("*").alias("total"))


def keyset(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The rows after a key, in order; the filter reaches the scan."""
    return df.where(F.col(key) > F.lit(after)).orderBy(key).limit(limit)


def nulls_last(c: str) -> list[Column]:
    return [F.col(c).isNull().asc(), F.col(c).asc()]


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def tri_state(flag: Column, wanted: bool | None) -> Column:
    """Any (None), yes or no."""
    return F.lit(True) if wanted is None else (flag if wanted else ~flag)


def systematic_sample(df: DataFrame, key: str, most: int, total: int) -> DataFrame:
    """Every n-th row by key, n the least step that keeps at most ``most`` of ``total``: deterministic."""
    return df.where(F.col(key) % sample_step(total, most) == 0)


def sample_step(total: int, most: int) -> int:
    return max(1, -(-total // max(1, most)))


def extrapolate(hit: Column, sampled: Column, total: Column) -> Column:
    """Hits among all from hits among a sample, in integers, at most all."""
    return F.when(sampled > 0, F.least(F.floor(hit * total / sampled), total)).otherwise(F.lit(0)).cast("long")
