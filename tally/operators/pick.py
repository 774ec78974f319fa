"""One variant of each group: ranks, picks and inferred groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_per_key


def preference_rank(value: Column, preferred: Sequence[str]) -> Column:
    """Place of a value in a list of preferences; after all of them if it is not there."""
    place = F.array_position(F.array(*map(F.lit, preferred)), value)
    return F.coalesce(F.nullif(place, F.lit(0).cast("long")), F.lit(len(preferred) + 1).cast("long"))


def list_rank(values: Column, preferred: Sequence[str]) -> Column:
    """Best place of any value of a list."""
    return F.coalesce(F.array_min(F.transform(values, lambda v: preference_rank(v, preferred))), F.lit(len(preferred) + 1).cast("long"))


def language_rank(languages: Column, preferred: Sequence[str]) -> Column:
    """0 for a preferred language, 1 for no tag, 2 for others."""
    return F.when(F.size(languages) == 0, 1).when(F.arrays_overlap(languages, F.array(*map(F.lit, preferred))), 0).otherwise(2)


def pick(variants: DataFrame, group: Sequence[str], order: Sequence[Column], hidden: Column | None = None) -> DataFrame:
    """The first variant of each group that is not hidden."""
    shown = variants if hidden is None else variants.where(~hidden)
    return first_per_key(shown, group, order)


def revision_rank(variants: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return variants.withColumn("revision_rank", F.dense_rank().over(Window.partitionBy(*group).orderBy(*order)))


def infer_groups(entries: DataFrame, key: str, entry: str, order: Sequence[Column]) -> DataFrame:
    """Entries of one key form a group; its parent is the pick, which comes first."""
    parents = first_per_key(entries, [key], order).select(key, F.col(entry).alias("parent"))
    return entries.join(parents, key)


def store_picks(stored: DataFrame, picks: DataFrame, group: Sequence[str], entry: str) -> DataFrame:
    """Changes that turn the stored picks into the new ones; rows that agree are left out."""
    a, b = stored.withColumnRenamed(entry, "old"), picks.select(*group, F.col(entry).alias("new"))
    return a.join(b, list(group), "full").where(~F.col("old").eqNullSafe(F.col("new")))
