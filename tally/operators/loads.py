"""Loading a version of a catalogue: entries, items and tags replaced, files unmatched, versions retired."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .diff import numbered
from .relational import first_per_key

HASHES = ("size", "crc32", "md5", "sha1")


def entry_ids(listed: DataFrame, entries: DataFrame, versions: DataFrame, version: int) -> DataFrame:
    """listed (domain, name) with entry_id: the entry of that name in the version itself, else in the latest version of its family; null for new ones."""
    family = versions.where(F.col("id") == version).select("family")
    mine = versions.join(family, "family", "left_semi").select(F.col("id").alias("version_id"), "loaded_at")
    known = entries.where(F.col("source") == S.ENTRY_SOURCE.index("dat")).join(mine, "version_id")
    best = first_per_key(known, ["domain", "name"], [(F.col("version_id") == version).desc(), F.col("loaded_at").desc(), F.col("id")])
    return listed.join(best.select("domain", "name", F.col("id").alias("entry_id")), ["domain", "name"], "left")


def put_entries(listed: DataFrame, entries: DataFrame, versions: DataFrame, version: int) -> DataFrame:
    """(id, domain, name, version_id, existed) after a load: entries of the family are reused, new ones numbered after the largest id."""
    found = entry_ids(listed.select("domain", "name").distinct(), entries, versions, version)
    top = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = numbered(found.where("entry_id is null"), ["domain", "name"], "at").crossJoin(top)  # one row
    old = found.where("entry_id is not null").select(F.col("entry_id").alias("id"), "domain", "name", F.lit(True).alias("existed"))
    new = fresh.select((F.col("top") + F.col("at")).alias("id"), "domain", "name", F.lit(False).alias("existed"))
    return old.unionByName(new).withColumn("version_id", F.lit(version).cast("long"))


def put_items(listed: DataFrame, items: DataFrame) -> DataFrame:
    """(entry_id, name, size, crc32, md5, sha1, retired) of the entries that listed has: its items, and the former ones it lacks as retired."""
    touched = listed.select("entry_id").distinct()
    old = items.join(touched, "entry_id", "left_semi").join(listed.select("entry_id", "name"), ["entry_id", "name"], "left_anti")
    columns = ["entry_id", "name", *HASHES]
    return listed.select(*columns, F.lit(False).alias("retired")).unionByName(old.select(*columns, F.lit(True).alias("retired")))


def unmatch_changed(files: DataFrame, items: DataFrame, listed: DataFrame) -> DataFrame:
    """files whose item is listed with another size or hash lose it: unverified if they were hashed, else pending.

    Disc images that wait for their tracks (rule chd, no digests) keep their match.
    """
    now = listed.select("entry_id", "name", *[F.col(c).alias(f"new_{c}") for c in HASHES])
    differs = F.lit(False)
    for c in HASHES:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    changed = items.join(now, ["entry_id", "name"]).where(differs).select(F.col("id").alias("item_id")).distinct().withColumn("changed", F.lit(True))
    digests = F.col("sha1").isNotNull() | F.col("md5").isNotNull()
    waits = (F.col("header_rule") == S.HEADER_RULE.index("chd")) & ~digests
    hit = F.col("changed").isNotNull() & ~F.coalesce(waits, F.lit(False))
    code = F.when(digests, S.FILE_STATE.index("unverified")).otherwise(S.FILE_STATE.index("pending"))
    rows = files.join(changed, "item_id", "left")
    return rows.withColumns({"state": F.when(hit, code).otherwise(F.col("state")), "item_id": F.when(~hit, F.col("item_id"))}).select(files.columns)


def retire_version(entries: DataFrame, items: DataFrame, transfers: DataFrame, version: int, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries, items and transfers after a version goes: its entries retire, unpicked and unwanted, with their items; unstarted transfers are cancelled."""
    mine = (F.col("version_id") == version) & (F.col("source") == S.ENTRY_SOURCE.index("dat"))
    gone = entries.where(mine).select(F.col("id").alias("entry_id"), F.lit(True).alias("gone"))
    new = {"retired": True, "is_pick": False, "wanted": False}
    after = entries.withColumns({c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in new.items()})
    retired = items.join(gone, "entry_id", "left").withColumn("retired", F.coalesce("gone", F.lit(False)) | F.col("retired")).select(items.columns)
    stops = F.col("gone").isNotNull() & F.col("state").isin(S.codes(S.TRANSFER_STATE, S.UNSTARTED))
    moved = {"state": F.lit(S.TRANSFER_STATE.index("cancelled")), "updated_at": F.lit(now)}
    stopped = transfers.join(gone, "entry_id", "left").withColumns({c: F.when(stops, v).otherwise(F.col(c)) for c, v in moved.items()}).select(transfers.columns)
    return after, retired, stopped


def put_tags(stored: DataFrame, listed: DataFrame, key: str, pos: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows, changed): ordered lists replaced where they differ, repeats left out; changed holds the keys that were written."""
    first = first_per_key(listed, [key, value], [F.col(pos)])
    dense = first.withColumn(pos, F.row_number().over(Window.partitionBy(key).orderBy(pos)) - 1).select(key, pos, value)
    mine = stored.join(listed.select(key).distinct(), key, "left_semi").select(key, pos, value)
    a, b = mine.withColumn("old", F.lit(True)), dense.withColumn("new", F.lit(True))
    changed = a.join(b, [key, pos, value], "full").where("old is null or new is null").select(key).distinct()
    rows = stored.select(key, pos, value).join(changed, key, "left_anti").unionByName(dense.join(changed, key, "left_semi"))
    return rows, changed


def replace_container(stored: DataFrame, listed: DataFrame, container: Sequence[str], path: str, values: Sequence[str]) -> DataFrame:
    """(container, path, action) for members of listed containers: delete those that are gone, write new ones and those that differ."""
    mine = stored.join(listed.select(*container).distinct(), list(container), "left_semi")
    a = mine.select(*container, path, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("old"))
    b = listed.select(*container, path, *values, F.lit(True).alias("new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"old_{v}"))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull() | ~same, "write")
    return a.join(b, [*container, path], "full").withColumn("action", action).where("action is not null").select(*container, path, "action")


def recompute_groups(entries: DataFrame, items: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """(id, root): the effective group of every entry.

    An entry's root is the first of its group key in an order; entries of several
    versions with the same items share the root of the earliest; a root that is not
    live hands over to the least live member.
    """
    from .groups import reroot, signature

    w = Window.partitionBy("domain", "group_key").orderBy(*order)
    own = entries.withColumn("parent", F.first("id").over(w))
    signed = signature(items, ["entry_id"], key)
    rows = own.join(signed.select(F.col("entry_id").alias("id"), "signature"), "id", "left")
    shared = rows.where("signature is not null").groupBy("domain", "signature").agg(F.min("parent").alias("anchor"), F.count_distinct("version_id").alias("versions")).where("versions > 1")
    linked = rows.join(shared, ["domain", "signature"], "left")
    # the roots of linked groups: depth one, since an anchor is the least parent of its signature
    moved = linked.where("anchor < parent").groupBy("parent").agg(F.min("anchor").alias("to"))
    joined = linked.join(moved, "parent", "left").withColumn("target", F.coalesce("to", "parent"))
    return reroot(joined.select("id", "target", "retired"), "id", "target", ~F.col("retired")).select("id", "root")


def derive_keys(rows: DataFrame, name: str, keys: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """rows with derived keys filled in where they are missing."""
    return rows.withColumns({c: F.coalesce(F.col(c), f(name)) for c, f in keys.items()})


def refreshed(rows: DataFrame, column: str, value: Column) -> DataFrame:
    """Only the rows whose stored value differs from the computed one, with the latter."""
    return rows.withColumn("new_value", value).where(~F.col("new_value").eqNullSafe(F.col(column))).withColumn(column, F.col("new_value")).drop("new_value")


def put_settings(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value rows after changes; a null value removes its key."""
    kept = stored.join(changes.select("key"), "key", "left_anti")
    return kept.unionByName(changes.where("value is not null").select(stored.columns))


def migrate(df: DataFrame, have: int, steps: Mapping[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """df brought from a schema version to the latest by the steps after it, in order."""
    for version in sorted(v for v in steps if v > have):
        df = steps[version](df)
    return df


def layout_known(items: DataFrame, layouts: DataFrame, layout: str) -> DataFrame:
    """(layout, known): whether some entry has exactly one live item for each size of a layout, as multisets.

    items: entry_id, size. layouts: layout, size. Both sides are counted by size first.
    """
    digest = lambda df, by: df.groupBy(by, "size").agg(F.count("*").alias("k")).groupBy(by).agg(F.count("*").alias("sizes"), F.sum("k").alias("n"), F.array_sort(F.collect_list(F.struct("size", "k"))).alias("all"))
    have = digest(items, "entry_id").select("all").distinct().withColumn("known", F.lit(True))
    return digest(layouts, layout).join(have, "all", "left").select(layout, F.coalesce("known", F.lit(False)).alias("known"))


def alternative_only(groups: DataFrame, entries: DataFrame, alternative: Column) -> DataFrame:
    """Groups of domains that have a live entry of the alternative catalogue keep those of that catalogue alone."""
    domains = entries.where(alternative & ~F.col("retired")).select("domain").distinct().withColumn("only", F.lit(True))
    return groups.join(domains, "domain", "left").where(F.col("only").isNull() | alternative).drop("only")


def rematch_stored(files: DataFrame, items: DataFrame) -> DataFrame:
    """(file_id, item_id, tier) of files by hashes they already have, strongest first: sha1, md5, crc32 with size; files without hashes are left out.

    Of the items of a hash the least id alone can be a file's match, so each hash has
    one item before it meets the files: hits are at most a row for each file and tier.
    """
    parts = []
    for tier, key in enumerate((["sha1"], ["md5"], ["crc32", "size"])):
        has = " and ".join(f"{k} is not null" for k in key)
        f = files.where(has).select(F.col("id").alias("file_id"), *key)
        first = items.where(f"not retired and {has}").groupBy(*key).agg(F.min("id").alias("item_id"))
        parts.append(f.join(first, key).select("file_id", "item_id", F.lit(tier).alias("tier")))
    hits = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return first_per_key(hits, ["file_id"], [F.col("tier"), F.col("item_id")])


def retired_matches(files: DataFrame, items: DataFrame, entries: DataFrame) -> DataFrame:
    """files matched to an item that is retired, or whose entry is."""
    gone = items.join(entries.select(F.col("id").alias("entry_id"), F.col("retired").alias("entry_retired")), "entry_id").where("retired or entry_retired")
    return files.join(gone.select(F.col("id").alias("item_id")), "item_id", "left_semi").select(files.columns)


def other_versions(entries: DataFrame, root: str = "group_root") -> DataFrame:
    """(id, other): pairs of live entries of one group in different versions."""
    a = entries.where("not retired").select("id", root, F.col("version_id").alias("v"))
    b = a.select(F.col("id").alias("other"), root, F.col("v").alias("w"))
    return a.join(b, root).where("v != w").select("id", "other")


def numbering_gaps(rows: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """by, whole: whether the numbers of a key run from 1 without gap or repeat."""
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(number).alias("a"), F.max(number).alias("b"), F.count_distinct(number).alias("d"))
    return n.select(*by, ((F.col("a") == 1) & (F.col("b") == F.col("n")) & (F.col("d") == F.col("n"))).alias("whole"))


def pieces(changes: DataFrame, order: Sequence[str], size: int, name: str = "piece") -> DataFrame:
    """changes with the number of a bounded piece, in an order."""
    return numbered(changes, order, "at").withColumn(name, F.floor((F.col("at") - 1) / size)).drop("at")
