"""Entries, groups and their maintained summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import first_per_key


def entry_completeness(entries: DataFrame, items: DataFrame, entry: str, satisfied: Column) -> DataFrame:
    """entries with n, ok and complete; an entry without items is never complete.

    Items are summed before the join, so one row an entry is joined.
    """
    counts = items.groupBy(entry).agg(F.count("*").alias("n"), F.count_if(satisfied).alias("ok"))
    joined = entries.join(counts, entry, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "ok": F.coalesce("ok", F.lit(0))})
    return joined.withColumn("complete", (F.col("n") > 0) & (F.col("n") == F.col("ok")))


def group_summary(variants: DataFrame, keys: Sequence[str], bit: str = "bit", region: str = "region_bit", flagless: int = 0) -> DataFrame:
    """One row a group: variants, have, wanted, newest, least mask and unions of bits.

    unflagged_regions: regions of the variants that have no bit of ``flagless``.
    """
    free = F.col(bit).bitwiseAND(F.lit(flagless)) == 0 if flagless else F.lit(True)
    return variants.groupBy(*keys).agg(
        F.count("*").alias("variants"),
        F.count_if("complete").alias("have"),
        F.count_if("wanted").alias("wanted"),
        F.max("entry").alias("newest_id"),
        F.min(bit).alias("lean_flags"),
        F.bit_or(bit).alias("flag_union"),
        F.bit_or(region).alias("region_union"),
        F.bit_or(F.when(free, F.col(region)).otherwise(F.lit(0).cast("long"))).alias("unflagged_regions"),
    )


def mask_sets(variants: DataFrame, keys: Sequence[str], bit: str = "bit", region: str = "region_bit") -> DataFrame:
    """One row a group: the distinct pairs of masks among its variants, of which there are few whatever the group's size."""
    return variants.select(*keys, bit, region).distinct().groupBy(*keys).agg(F.collect_list(F.struct(F.col(bit).alias("bit"), F.col(region).alias("region"))).alias("masks"))


def refresh(stored: DataFrame, dirty: DataFrame, keys: Sequence[str], recompute) -> DataFrame:
    """A summary brought up to date: rows of dirty keys are dropped and computed anew.

    recompute(keys) makes the summary of the given keys alone, so that the work
    follows the change and not the table.
    """
    changed = dirty.select(*keys).distinct()
    fresh = recompute(changed)
    return stored.join(changed, list(keys), "left_anti").unionByName(fresh.select(stored.columns))


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on either side of any row that is in one snapshot and not in the other."""
    return old.exceptAll(new).select(*keys).union(new.exceptAll(old).select(*keys)).distinct()


def drift(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows that only one of the two has: stale and missing."""
    stale = stored.subtract(fresh).agg(F.count("*").alias("stale"))
    missing = fresh.subtract(stored).agg(F.count("*").alias("missing"))
    return stale.crossJoin(missing)  # one row each


def reroot(nodes: DataFrame, node: str, target: str, live: Column) -> DataFrame:
    """Groups whose root points elsewhere get the least live member as root, else the least.

    One aggregation over the groups and one join; depth one needs no iteration.
    """
    n, t = F.col(node), F.col(target)
    stands = F.bool_or(n == t)
    roots = nodes.groupBy(t.alias("_target")).agg(F.coalesce(F.when(stands, F.first(t)), F.min(F.when(live, n)), F.min(n)).alias("root"))
    return nodes.join(roots, t == F.col("_target")).drop("_target")


def root_of(*candidates: str) -> Column:
    return F.coalesce(*candidates)


def signature(items: DataFrame, entry: Sequence[str], key: Column) -> DataFrame:
    """A digest of an entry's keys that ignores their order; none where a key is missing.

    Number, sum and xor of the keys' hashes: added up map-side, no list of keys is held.
    """
    h = F.xxhash64("_k")
    sums = items.withColumn("_k", key).groupBy(*entry).agg(F.count("*").alias("n"), F.count("_k").alias("_keys"), F.bit_xor(h).alias("_x"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("_s"))
    return sums.where(F.col("n") == F.col("_keys")).select(*entry, F.concat_ws("-", "n", F.hex("_s"), F.hex("_x")).alias("signature"), "n")


def link_shared(entries: DataFrame, signed: DataFrame, entry: str, version: str) -> DataFrame:
    """Entries of equal signature in several versions, linked to the anchor: of the largest version, then the earliest."""
    sizes = entries.groupBy(version).agg(F.count("*").alias("_size"))
    rows = entries.join(signed, entry).join(sizes, version)
    largest = sizes.agg(F.max("_size").alias("_most"))
    ranked = rows.crossJoin(largest).withColumn("_anchor", F.col("_size") == F.col("_most"))  # one row
    anchors = first_per_key(ranked, ["signature"], [F.desc("_anchor"), F.col(version), F.col(entry)]).select("signature", F.col(entry).alias("anchor"))
    return rows.join(anchors, "signature").where(F.col(entry) != F.col("anchor")).select(entry, version, "anchor")


def stamp(rows: DataFrame, by: Sequence[str], *columns: str, hashed=F.xxhash64) -> DataFrame:
    """A digest of a set of rows for equality checks: count, and order-free sums of a hash."""
    h = hashed(*columns)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))


def domain_counts(groups: DataFrame, domain: str) -> DataFrame:
    return groups.groupBy(domain).agg(F.count("*").alias("groups"), F.count_if(F.col("have") > 0).alias("have"), F.count_if(F.col("wanted") > 0).alias("wanted"))


def shared_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The single distinct value of a group, else null."""
    return df.groupBy(*by).agg(F.when(F.count_distinct(value) == 1, F.max(value)).alias(value))


def listing(df: DataFrame, by: Sequence[str], value: str, sep: str = ",") -> DataFrame:
    """Distinct values of a group in order as one text."""
    return df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(value))


def detail(groups: DataFrame, variants: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Groups with their variants as a sorted list of structs."""
    nested = variants.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("members"))
    return groups.join(nested, list(keys), "left")
