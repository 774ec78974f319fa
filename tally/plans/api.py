"""What callers can ask, as functions that return (page, total) or one DataFrame.

``tables`` is a mapping of table names of tally.schema to DataFrames. Pages take a
limit (100, at most 1000) and an offset.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import ascii_contains
from ..operators import bind, browse, diff, relational, state
from . import views

Tables = Mapping[str, DataFrame]


def domains(tables: Tables, groups: DataFrame, limit: int = 100, offset: int = 0):
    """Domains with their counts of groups, complete ones, wanted ones, and files by state."""
    g = groups.groupBy(F.col("domain").alias("id")).agg(F.count("*").alias("groups"), F.count_if(F.col("have") > 0).alias("have"), F.count_if(F.col("wanted") > 0).alias("wanted"))
    files = tables["files"].withColumn("_s", S.word("state", S.FILE_STATE)).groupBy(F.col("domain").alias("id")).pivot("_s", list(S.FILE_STATE)).count()
    rows = tables["domains"].join(g, "id", "left").join(files, "id", "left").na.fill(0)
    return relational.page_with_total(rows, [F.col("slug")], limit, offset)


def unidentified(tables: Tables, domain: int, limit: int = 100, offset: int = 0):
    rows = views.file_view(tables["files"], tables["domains"]).where((F.col("domain") == domain) & (F.col("state_text") == "unidentified"))
    return relational.page_with_total(rows.select("id", "rel_path", "size", "reason_text"), [F.col("rel_path"), F.col("id")], limit, offset)


def entries(groups: DataFrame, variants: DataFrame, domain: int, chosen: browse.Filter, limit: int = 100, offset: int = 0):
    """Groups of a domain that a filter shows."""
    mine = groups.where(F.col("domain") == domain)
    return browse.browse(mine, variants, ["root", "domain"], chosen, "base_name", "root", limit, offset)


def entry(tables: Tables, groups: DataFrame, root: int) -> DataFrame:
    """One group with its variants, and their items with the best file of each."""
    loadable = S.codes(S.FILE_STATE, S.LOADABLE)
    order = [F.col("state").isin(loadable).desc(), F.col("state"), F.col("id")]
    best = relational.first_per_key(tables["files"].where("item_id is not null"), ["item_id"], order).select("item_id", F.col("rel_path"), F.col("state").alias("file_state"))
    mine = tables["entries"].where(F.coalesce("group_root", "parent_id", "id") == root).select(F.col("id").alias("entry_id"), F.col("name").alias("entry_name"), "is_pick", "wanted")
    items = tables["items"].where("not retired").join(mine, "entry_id").withColumnRenamed("id", "item_id").join(best, "item_id", "left")
    nested = items.groupBy("entry_id", "entry_name", "is_pick", "wanted").agg(F.sort_array(F.collect_list(F.struct("item_id", "name", "size", "rel_path", "file_state"))).alias("items"))
    variants = nested.agg(F.sort_array(F.collect_list(F.struct("entry_id", "entry_name", "is_pick", "wanted", "items"))).alias("members"))
    return groups.where(F.col("root") == root).crossJoin(variants)  # one row


def versions(tables: Tables, limit: int = 100, offset: int = 0):
    v = tables["versions"]
    newer = v.select(F.col("id").alias("superseded_by"), F.col("version").alias("newer_version"))
    rows = v.join(newer, "superseded_by", "left")
    return relational.page_with_total(rows, [F.col("loaded_at").desc(), F.col("id").desc()], limit, offset)


def sources(tables: Tables, limit: int = 100, offset: int = 0):
    """Sources with the number of their offers that have a match, proven or candidate."""
    proven = tables["offers"].where("item_id is not null").select("source_id", "file_index")
    hits = proven.union(tables["candidates"].select("source_id", "file_index")).distinct().groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("matched"))
    rows = tables["sources"].join(hits, "id", "left").withColumns({"matched": F.coalesce("matched", F.lit(0)), "state_text": S.word("state", S.SOURCE_STATE)})
    return relational.page_with_total(rows, [F.col("added_at").desc(), F.col("id").desc()], limit, offset)


def offers(tables: Tables, source: int, matched: bool | None = None, search: str | None = None, limit: int = 100, offset: int = 0):
    """Offers of a source with their item, whether they have any match, and their latest transfer."""
    rows = views.offer_view(tables["offers"].where(F.col("source_id") == source))
    rows = relational.exists_flag(rows, tables["candidates"], ["source_id", "file_index"], "_candidate")
    rows = rows.withColumn("matched", F.col("item_id").isNotNull() | F.col("_candidate")).drop("_candidate")
    latest = views.latest_transfers(tables["transfers"]).select("source_id", "file_index", S.word("state", S.TRANSFER_STATE).alias("transfer"))
    rows = rows.join(latest, ["source_id", "file_index"], "left").where(relational.tri_state(F.col("matched"), matched))
    if search:
        rows = rows.where(ascii_contains("path", search))
    return relational.page_with_total(rows, [F.col("file_index")], limit, offset)


def preview(tables: Tables, source: int, matches: DataFrame, most: int = 2000) -> DataFrame:
    """Estimated matches by domain from a systematic sample of a source's offers."""
    mine = tables["offers"].where(F.col("source_id") == source)
    total = mine.count()
    sample = relational.systematic_sample(mine, "file_index", most, total)
    hits = bind.domain_hits(matches.join(sample.select("source_id", "file_index"), ["source_id", "file_index"], "left_semi"), "source_id", "domain", ["file_index"])
    sampled = sample.agg(F.count("*").alias("sampled"))
    return hits.crossJoin(sampled).select("domain", "hits", relational.extrapolate(F.col("hits"), F.col("sampled"), F.lit(total)).alias("estimate"))  # one row


def transfers(tables: Tables, states: Sequence[str] = (), limit: int = 100, offset: int = 0):
    rows = tables["transfers"].withColumn("state_text", S.word("state", S.TRANSFER_STATE))
    rows = rows.where(F.col("state").isin(S.codes(S.TRANSFER_STATE, tuple(states)))) if states else rows
    return relational.page_with_total(rows, [F.col("updated_at").desc(), F.col("id").desc()], limit, offset)


def cancel(tables: Tables, ids: DataFrame, now: int) -> DataFrame:
    """transfers with the given ones cancelled where their state allows it."""
    marks = ids.select("id").distinct().withColumn("_mark", F.lit(True))
    may = F.col("_mark").isNotNull() & F.col("state").isin(S.codes(S.TRANSFER_STATE, S.CANCELLABLE))
    rows = tables["transfers"].join(marks, "id", "left")
    to = F.lit(S.TRANSFER_STATE.index("cancelled")).cast("tinyint")
    return rows.withColumns({"state": F.when(may, to).otherwise(F.col("state")), "updated_at": F.when(may, F.lit(now)).otherwise(F.col("updated_at"))}).drop("_mark")


def audit(tables: Tables, limit: int = 100, offset: int = 0):
    rows = tables["audit"].withColumn("action_text", S.word("action", S.IMPORT_ACTION))
    return relational.page_with_total(rows, [F.col("at").desc(), F.col("id").desc()], limit, offset)


def active_jobs(tables: Tables, limit: int = 100, offset: int = 0):
    rows = tables["jobs"].where(F.col("state").isin(S.codes(S.JOB_STATE, S.ACTIVE_JOBS)))
    return relational.page_with_total(rows, [F.col("id")], limit, offset)


def recent_jobs(tables: Tables, limit: int = 10) -> DataFrame:
    """Finished jobs, neighbours of one kind, state and lane folded into one row."""
    done = tables["jobs"].where(~F.col("state").isin(S.codes(S.JOB_STATE, S.ACTIVE_JOBS)))
    runs = state.fold_runs(done, ["lane"], ["updated_at", "id"], ["kind", "state"])
    return runs.orderBy(F.col("last.updated_at").desc(), F.col("last.id").desc()).limit(limit)


def load_version(tables: Tables, listed: DataFrame, version: int) -> DataFrame:
    """entries after a version was loaded: those it does not list any more are retired."""
    mine = tables["entries"].where(F.col("version_id") == version)
    return tables["entries"].where(F.col("version_id") != version).unionByName(diff.mark_and_sweep(mine, listed, ["name"]).select(tables["entries"].columns))
