"""Snapshots: diffs, upserts, sweeps and supersession, as new versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import written
from .relational import first_per_key


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, change (added / removed / changed), old_ and new_ values; equal rows are left out."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_a"))
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_b"))
    differ = F.lit(False)
    for v in values:
        differ = differ | ~F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differ, "changed")
    return a.join(b, list(keys), "full").withColumn("change", change).where("change is not null").drop("_a", "_b")


def upsert(base: DataFrame, delta: DataFrame, keys: Sequence[str], id_column: str | None = None) -> DataFrame:
    """base with the rows of delta written over or added; new rows get ids after the largest.

    Ids of new rows are dense and in key order: ranks within range partitions
    plus the counts of earlier partitions, so no task sees all new rows.
    """
    values = [c for c in base.columns if c not in keys and c != id_column]
    d = delta.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_d"))
    merged = base.withColumn("_b", F.lit(True)).join(d, list(keys), "full")
    out = {v: F.when(F.col("_d"), F.col(f"_new_{v}")).otherwise(F.col(v)) for v in values}
    rows = merged.withColumns(out)
    if id_column is None:
        return rows.select(base.columns)
    kept = rows.where("_b").select(base.columns)
    top = base.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    fresh = numbered(rows.where("_b is null").drop(id_column), keys, "_n")
    fresh = fresh.crossJoin(top).withColumn(id_column, F.col("_top") + F.col("_n"))  # top is one row
    return kept.unionByName(fresh.select(base.columns))


#: Rows up to which one task ranks them all.
ONE_TASK = 1 << 17


def numbered(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Dense numbers from 1 in key order, without one task for all rows beyond ONE_TASK.

    Rows are dealt out to sorted ranges and written once with their place, a range and a
    rank in it; a number is the rank plus the counts of earlier ranges. All readers see
    the same ranges, and none sorts again.
    """
    n = df.count()
    if n <= ONE_TASK:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long"))
    ranged = df.repartitionByRange(-(-n // ONE_TASK), *keys).sortWithinPartitions(*keys)
    # the partition above 33 bits, the row in it below
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_c")).select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_first"))
    rank = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.withColumn("_part", part).join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + rank).drop("_part", "_at", "_first")


def upsert_changed(base: DataFrame, delta: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Only the rows of delta that are new or differ from base."""
    a = base.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in values], F.lit(True).alias("_b"))
    same = F.col("_b").isNotNull()
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    return delta.join(a, list(keys), "left").where(~same).select(delta.columns)


def mark_and_sweep(stored: DataFrame, listed: DataFrame, keys: Sequence[str], retired: str = "retired") -> DataFrame:
    """stored with the flag set exactly on the rows that the new list lacks."""
    marks = listed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return stored.join(marks, list(keys), "left").withColumn(retired, F.col("_seen").isNull()).drop("_seen")


def retire_unseen(stored: DataFrame, run_column: str, run: int, retired: str = "retired") -> DataFrame:
    return stored.withColumn(retired, F.col(retired) | ~F.col(run_column).eqNullSafe(F.lit(run)))


def delete_missing(stored: DataFrame, listed: DataFrame, keys: Sequence[str], path: str, unreadable: Sequence[str] = ()) -> DataFrame:
    """stored without the rows that the list lacks, except under prefixes that could not be read."""
    spared = F.lit(False)
    for prefix in unreadable:
        spared = spared | F.col(path).startswith(prefix)
    marks = listed.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return stored.join(marks, list(keys), "left").where(F.col("_seen").isNotNull() | spared).drop("_seen")


def supersede(versions: DataFrame, family: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """versions with superseded_by: the newest version of the family, null on itself."""
    newest = first_per_key(versions, family, [F.col(c).desc_nulls_last() for c in order]).select(*family, F.col(key).alias("_newest"))
    joined = versions.join(newest, list(family))
    return joined.withColumn("superseded_by", F.when(F.col(key) != F.col("_newest"), F.col("_newest"))).drop("_newest")


def intern(values: DataFrame, dictionary: DataFrame, key: str, number: str) -> DataFrame:
    """The dictionary with ids for values that it lacks."""
    fresh = values.select(key).where(F.col(key).isNotNull()).distinct().join(dictionary, key, "left_anti")
    top = dictionary.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    added = numbered(fresh, [key], "_n").crossJoin(top).select(key, (F.col("_top") + F.col("_n")).alias(number))  # top is one row
    return dictionary.select(key, number).unionByName(added)


def null_out(rows: DataFrame, gone: DataFrame, reference: str, key: str) -> DataFrame:
    """rows whose reference points at a deleted key lose it."""
    marks = gone.select(F.col(key).alias(reference)).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marks, reference, "left").withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).drop("_gone").select(rows.columns)


def keep_proofs(old: DataFrame, new: DataFrame, keys: Sequence[str], proof: Sequence[str]) -> DataFrame:
    """A replaced list that keeps what was proven of rows whose keys are unchanged."""
    return new.drop(*proof).join(old.select(*keys, *proof), list(keys), "left")


def apply_matches(stored: DataFrame, change: DataFrame, keys: Sequence[str], value: str, proven: str) -> DataFrame:
    """stored with new matches, except on rows whose match is proven."""
    d = change.select(*keys, F.col(value).alias("_value"), F.lit(True).alias("_d"))
    take = F.col("_d").isNotNull() & ~F.coalesce(F.col(proven), F.lit(False))
    return stored.join(d, list(keys), "left").withColumn(value, F.when(take, F.col("_value")).otherwise(F.col(value))).select(stored.columns)


def presence(listed: DataFrame, stored: DataFrame, key: Sequence[str], stamp: str, check: str) -> DataFrame:
    """What to do with each path: record new ones, drop gone ones, restamp or reverify changed ones."""
    a = listed.select(*key, F.col(stamp).alias("_stamp"), F.col(check).alias("_check"), F.lit(True).alias("_l"))
    b = stored.select(*key, F.col(stamp).alias("_old"), F.col(check).alias("_old_check"), F.lit(True).alias("_s"))
    action = F.when(F.col("_s").isNull(), "record").when(F.col("_l").isNull(), "drop").when(~F.col("_check").eqNullSafe(F.col("_old_check")), "reverify").when(~F.col("_stamp").eqNullSafe(F.col("_old")), "restamp")
    return a.join(b, list(key), "full").select(*key, action.alias("action")).where("action is not null")
