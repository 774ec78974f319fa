"""Views of catalogue tables: codes as words, names composed, live rows, group summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import compose_name
from ..operators.relational import first_per_key


def _hex(c: str):
    return F.nullif(F.lower(F.hex(c)), F.lit("")).alias(f"{c}_hex")


def item_view(items: DataFrame, entries: DataFrame, entry_tags: DataFrame, bios_tag: int) -> DataFrame:
    """Items with full names, hex digests, words, and whether they are live and of a BIOS entry."""
    e = entries.select(F.col("id").alias("entry_id"), F.col("name").alias("entry_name"), "version_id", "domain", "group_root", "parent_id", F.col("source").alias("entry_source"), F.col("retired").alias("entry_retired"))
    bios = entry_tags.where(F.col("tag_id") == bios_tag).select("entry_id").distinct().withColumn("_bios", F.lit(True))
    rows = items.join(e, "entry_id").join(bios, "entry_id", "left")
    return rows.withColumns({
        "name": compose_name("entry_name", "name", "own_name"), "status_text": S.word("status", S.ITEM_STATUS), "live": ~F.col("retired") & ~F.col("entry_retired"), "bios": F.col("_bios").isNotNull(),
        "crc32_hex": _hex("crc32"), "md5_hex": _hex("md5"), "sha1_hex": _hex("sha1"),
    }).drop("_bios")


def live_item_view(items: DataFrame, entries: DataFrame, entry_tags: DataFrame, bios_tag: int) -> DataFrame:
    return item_view(items, entries, entry_tags, bios_tag).where("live and not bios")


def file_view(files: DataFrame, domains: DataFrame) -> DataFrame:
    slugs = domains.select(F.col("id").alias("domain"), F.col("slug").alias("domain_slug"))
    words = {"header_rule_text": S.word("header_rule", S.HEADER_RULE), "state_text": S.word("state", S.FILE_STATE), "reason_text": S.word("reason", S.REASON)}
    return files.join(slugs, "domain", "left").withColumns(words | {f"{c}_hex": _hex(c) for c in ("crc32", "md5", "sha1")})


def entry_view(entries: DataFrame, domains: DataFrame) -> DataFrame:
    slugs = domains.select(F.col("id").alias("domain"), F.col("slug").alias("domain_slug"))
    return entries.join(slugs, "domain", "left").withColumns({"source_text": S.word("source", S.ENTRY_SOURCE), "check_text": S.word("check", S.MRA_CHECK)})


def offer_view(offers: DataFrame) -> DataFrame:
    return offers.withColumn("confidence_text", S.word("confidence", S.CONFIDENCE))


def tag_lists(entry_tags: DataFrame, tags: DataFrame, kind: str) -> DataFrame:
    """entry_id and its tags of a kind in their order."""
    named = entry_tags.join(tags.where(F.col("kind") == S.TAG_KIND.index(kind)).select(F.col("id").alias("tag_id"), "name"), "tag_id")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return named.groupBy("entry_id").agg(listed.alias(f"{kind}s"))


def tag_masks(entry_tags: DataFrame, tags: DataFrame, other: int = 1 << 62) -> DataFrame:
    """entry_id with the union of its flag bits and of its region bits; unknown tags share one bit."""
    bits = entry_tags.join(tags.select(F.col("id").alias("tag_id"), "kind", F.coalesce("bit", F.lit(other)).alias("bit")), "tag_id")
    side = lambda kind: F.coalesce(F.bit_or(F.when(F.col("kind") == S.TAG_KIND.index(kind), F.col("bit"))), F.lit(0).cast("long"))
    return bits.groupBy("entry_id").agg(side("flag").alias("flag_bits"), side("region").alias("region_bits"))


def group_summaries(entries: DataFrame, items: DataFrame, files: DataFrame, entry_tags: DataFrame, tags: DataFrame, known_flags: int) -> DataFrame:
    """One row a (group root, domain): the maintained summary of a catalogue.

    An item is satisfied by a verified file, or if it is present and its entry's
    check does not fail. Base name and source come from the root entry, which may
    be on another domain.
    """
    verified = files.where(F.col("state") == S.FILE_STATE.index("verified")).select(F.col("item_id").alias("id")).where("id is not null").distinct().withColumn("_file", F.lit(True))
    live = entries.where("not retired").select(F.col("id").alias("entry_id"), "domain", F.coalesce("group_root", "parent_id", "id").alias("root"), "wanted", "is_pick", F.coalesce("check", F.lit(0)).alias("check"))
    held = items.where("not retired").join(verified, "id", "left").select("entry_id", F.col("present"), F.col("_file").isNotNull().alias("_held"))
    counts = held.groupBy("entry_id").agg(F.count("*").alias("n"), F.count_if("_held").alias("by_file"), F.count_if(F.col("_held") | F.col("present")).alias("by_any"))
    v = live.join(counts, "entry_id", "left").join(tag_masks(entry_tags, tags), "entry_id", "left")
    ok = F.when(F.col("check") < S.FAILING_CHECK, F.col("by_any")).otherwise(F.col("by_file"))
    flag, region = F.coalesce("flag_bits", F.lit(0)), F.coalesce("region_bits", F.lit(0))
    summary = v.groupBy("root", "domain").agg(
        F.count("*").alias("variants"), F.count_if((F.col("n") > 0) & (ok == F.col("n"))).alias("have"), F.count_if("wanted").alias("wanted"), F.bool_or("is_pick").alias("has_pick"),
        F.max(F.when(F.col("is_pick"), F.col("entry_id"))).alias("pick_id"), F.max("entry_id").alias("newest_id"), F.min(flag.bitwiseAND(F.lit(known_flags))).alias("lean_flags"),
        F.bit_or(F.when(flag.bitwiseAND(F.lit(known_flags)) == 0, region).otherwise(0)).alias("unflagged_regions"), F.bit_or(flag).alias("flag_union"), F.bit_or(region).alias("region_union"),
    )
    roots = entries.select(F.col("id").alias("root"), "base_name", "source", F.col("domain").alias("_home"))
    return summary.join(roots, "root").withColumn("split", F.col("domain") != F.col("_home")).drop("_home")


def file_states(files: DataFrame, items: DataFrame, name_fits) -> DataFrame:
    """State of matched files: verified where the name fits, misnamed otherwise; bad dumps are bad, unmatched ones unverified."""
    i = items.select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), F.col("status").alias("item_status"))
    bad = S.ITEM_STATUS.index("baddump")
    state = F.when(F.col("item_name").isNull(), "unverified").when(F.col("item_status") == bad, "bad").when(name_fits, "verified").otherwise("misnamed")
    return files.join(i, "item_id", "left").withColumn("state_text", state)


def latest_transfers(transfers: DataFrame) -> DataFrame:
    """The last transfer of each offer, open ones first."""
    is_open = F.col("state").isin(S.codes(S.TRANSFER_STATE, S.OPEN))
    return first_per_key(transfers, ["source_id", "file_index"], [is_open.desc(), F.col("id").desc()])
