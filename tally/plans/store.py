"""Named reads and updates of a catalogue's tables.

A Store is a set of immutable tables; an update gives a new Store whose changed
table is an expression over the old one, so that a load or a request that makes
several updates is one plan. READS give tables, WRITES give stores; both take the
store and keyword parameters. Updates of many rows at once, by joins, are in
operators.lifecycle and operators.loads.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.text import ascii_lower
from ..operators.relational import first_per_key


class Store:
    """Tables by name."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def where(self, name: str, condition: Column) -> DataFrame:
        return self[name].where(condition)

    def get(self, name: str, **keys) -> DataFrame:
        return self.where(name, _match(keys))

    def count(self, name: str, condition: Column) -> DataFrame:
        return self.where(name, condition).agg(F.count("*").alias("n"))

    def exists(self, name: str, condition: Column) -> DataFrame:
        """One row; the scan ends with the first hit."""
        return self.where(name, condition).limit(1).agg((F.count("*") > 0).alias("found"))

    def put(self, name: str, rows: DataFrame) -> Store:
        return Store(self.tables | {name: rows})

    def set(self, name: str, condition: Column, **values) -> Store:
        now = F.coalesce(condition, F.lit(False))
        types = dict(self[name].dtypes)
        new = {c: F.when(now, _lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in values.items()}
        return self.put(name, self[name].withColumns(new))

    def delete(self, name: str, condition: Column) -> Store:
        return self.put(name, self[name].where(~F.coalesce(condition, F.lit(False))))


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _match(keys: Mapping) -> Column:
    out = F.lit(True)
    for c, v in keys.items():
        out = out & (F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c).eqNullSafe(_lit(v)))
    return out


def _is(column: str, table: tuple[str, ...], *words: str) -> Column:
    return F.col(column).isin(S.codes(table, words))


MRA, DAT = (S.ENTRY_SOURCE.index(w) for w in ("mra", "dat"))


def _live() -> Column:
    return ~F.col("retired")


def _scanned() -> Column:
    return (F.col("source") == MRA) & _live()


def _transfer(*words: str) -> Column:
    return _is("state", S.TRANSFER_STATE, *words)


def _job(*words: str) -> Column:
    return _is("state", S.JOB_STATE, *words)


READS: dict[str, Callable[..., DataFrame]] = {
    # scanned entries of domains that describe themselves
    "scanned.live_count": lambda s, domain: s.count("entries", _scanned() & (F.col("domain") == domain)),
    "scanned.has_any": lambda s, domain: s.exists("entries", _scanned() & (F.col("domain") == domain)),
    "scanned.at_path": lambda s, domain, path: s.where("entries", _scanned() & _match({"domain": domain, "path": path})).orderBy("id").limit(1),
    "scanned.by_set_name": lambda s, domain, name: s.where("entries", (F.col("domain") == domain) & (ascii_lower("name") == ascii_lower(F.lit(name)))).orderBy((F.col("name") == name).desc(), "id").limit(1),
    # offers and candidates
    "candidates.of_offer": lambda s, source, index: s.get("candidates", source_id=source, file_index=index).orderBy("confidence", "item_id"),
    "candidates.of_range": lambda s, source, first, last: s.where("candidates", (F.col("source_id") == source) & F.col("file_index").between(first, last)).orderBy("file_index", "confidence", "item_id"),
    "candidates.guessed": lambda s, source, index, item: s.exists("candidates", _match({"source_id": source, "file_index": index, "item_id": item}) & ~_is("confidence", S.CONFIDENCE, *S.FIRM)),
    "offers.in_order": lambda s, source: s.get("offers", source_id=source).orderBy("file_index"),
    "offers.path": lambda s, source, index: s.get("offers", source_id=source, file_index=index).select("path"),
    "offers.unmatched": lambda s, source: s.get("offers", source_id=source).where("item_id is null").join(s["candidates"].select("source_id", "file_index"), ["source_id", "file_index"], "left_anti"),
    # disc images that wait
    "images.waiting": lambda s, reasons, after, limit: s.where("files", (F.col("state") == S.FILE_STATE.index("unidentified")) & _is("reason", S.REASON, *reasons) & (F.col("id") > after)).orderBy("id").limit(limit),
    "images.waiting_count": lambda s, reasons: s.count("files", (F.col("state") == S.FILE_STATE.index("unidentified")) & _is("reason", S.REASON, *reasons)),
    "images.has_waiting": lambda s, reasons, domain=None: s.exists("files", (F.col("state") == S.FILE_STATE.index("unidentified")) & _is("reason", S.REASON, *reasons) & (F.lit(True) if domain is None else F.col("domain") == domain)),
    # versions
    "versions.get": lambda s, id: s.get("versions", id=id),
    # transfers
    "transfers.get": lambda s, id: s.get("transfers", id=id),
    "transfers.of_offer": lambda s, source, index: s.get("transfers", source_id=source, file_index=index).orderBy(_transfer(*S.OPEN).desc(), F.col("id").desc()).limit(1),
    "transfers.of_source": lambda s, source, states: s.get("transfers", source_id=source).where(_transfer(*states)).orderBy("id"),
    "transfers.selected": lambda s, source: s.get("transfers", source_id=source).where(_transfer(*S.SELECTED)).select("file_index").distinct(),
    "transfers.open_count": lambda s, source: s.count("transfers", (F.col("source_id") == source) & _transfer(*S.SELECTED)),
    "transfers.of_entry": lambda s, entry: s.get("transfers", entry_id=entry).select("id"),
    "transfers.finished": lambda s: s.where("transfers", ~_transfer(*S.OPEN)),
    "transfers.started": lambda s: s.where("transfers", _transfer(*S.STARTED)),
    "transfers.placed_any": lambda s, entry: s.get("transfers", entry_id=entry).select("id", "state").join(s["audit"].where(_is("action", S.IMPORT_ACTION, "placed")).select(F.col("transfer_id").alias("id")).distinct().withColumn("logged", F.lit(True)), "id", "left").agg(F.coalesce(F.bool_or(_transfer("done") | (_transfer("bad") & F.col("logged"))), F.lit(False)).alias("found")),
    # files
    "files.get": lambda s, id: s.get("files", id=id),
    "files.at_path": lambda s, domain, path: s.get("files", domain=domain, rel_path=path),
    "files.paths": lambda s, domain: s.get("files", domain=domain).select("rel_path"),
    "files.has_verified": lambda s, item: s.exists("files", (F.col("item_id") == item) & _is("state", S.FILE_STATE, "verified")),
    "files.verified": lambda s, item: s.where("files", (F.col("item_id") == item) & _is("state", S.FILE_STATE, "verified")).orderBy("id").limit(1),
    "files.hashed": lambda s: s.where("files", F.col("crc32").isNotNull() & F.col("md5").isNotNull() & F.col("sha1").isNotNull()),
    "files.misnamed": lambda s: s.where("files", _is("state", S.FILE_STATE, "misnamed")).join(s["items"].select(F.col("id").alias("item_id"), F.col("name").alias("item_name"), "entry_id"), "item_id"),
    # items
    "items.get": lambda s, id: s.get("items", id=id),
    "items.live_of": lambda s, entry: s.get("items", entry_id=entry).where(_live()),
    "items.count_of": lambda s, entry: s.count("items", F.col("entry_id") == entry),
    "items.entry_of": lambda s, id: s.get("items", id=id).select("entry_id"),
    "items.retired": lambda s, id: s.get("items", id=id).join(s["entries"].select(F.col("id").alias("entry_id"), F.col("retired").alias("of")), "entry_id").select((F.col("retired") | F.col("of")).alias("found")),
    "items.sized": lambda s, size, suffix: s.where("items", (F.col("size") == size) & ascii_lower("name").endswith(suffix) & _live()),
    # jobs
    "jobs.get": lambda s, id: s.get("jobs", id=id),
    "jobs.count_kind": lambda s, kind: s.count("jobs", F.col("kind") == kind),
    "jobs.open": lambda s: s.where("jobs", _job(*S.ACTIVE_JOBS)).orderBy("id"),
    "jobs.queued_of_kind": lambda s, kind: s.where("jobs", (F.col("kind") == kind) & _job("queued")).orderBy("id"),
    "jobs.open_in_lane": lambda s, lane: s.where("jobs", (F.col("lane") == lane) & _job(*S.ACTIVE_JOBS)).orderBy("id"),
    "jobs.other_in_lane": lambda s, lane, kind: s.exists("jobs", (F.col("lane") == lane) & (F.col("kind") != kind) & _job("queued")),
    # domains
    "domains.resolve": lambda s, slug: s.get("domains", slug=slug).select("id"),
    "domains.slug": lambda s, id: s.get("domains", id=id).select("slug"),
    "domains.count": lambda s: s.count("domains", F.lit(True)),
    "domains.list": lambda s: s["domains"].orderBy("slug"),
    "domains.with_entries": lambda s: s.where("entries", _live()).select("domain").distinct(),
    "domains.has_entries": lambda s, domain: s.exists("entries", _live() & (F.col("domain") == domain)),
    # sources
    "sources.get": lambda s, id: s.get("sources", id=id),
    "sources.by_infohash": lambda s, infohash: s.get("sources", infohash=infohash),
    "sources.resolving": lambda s: s.where("sources", _is("state", S.SOURCE_STATE, "resolving")).select("id", F.col("client_id").isNotNull().alias("in_client")),
    "sources.unbound": lambda s: s.where("sources", _is("state", S.SOURCE_STATE, "unbound") & ~F.coalesce("user_binding", F.lit(False))),
    "sources.of_domains": lambda s, domains: s.get("sources", domain=domains).select("id").distinct().orderBy("id"),
    "sources.mapped": lambda s: s.where("sources", F.col("domain").isNotNull()),
    "sources.in_client": lambda s: s.where("sources", F.col("client_id").isNotNull()),
    # scans that resume
    "scans.done": lambda s, domain: s.get("scans", domain=domain).select("unit"),
    "scans.domains": lambda s: s["scans"].select("domain").distinct(),
}


def _want(s: Store, entry: int, bios: DataFrame) -> Store:
    """Wanted unless the entry is retired or a BIOS (entry_id)."""
    marks = bios.select(F.col("entry_id").alias("id")).distinct().withColumn("bios", F.lit(True))
    rows = s["entries"].join(marks, "id", "left")
    may = (F.col("id") == entry) & _live() & F.col("bios").isNull()
    return s.put("entries", rows.withColumn("wanted", may | F.col("wanted")).select(s["entries"].columns))


def _unwant_group(s: Store, root: int, now: int) -> Store:
    """A group's entries are not wanted any more, and what has not started for them is cancelled."""
    mine = F.coalesce("group_root", "id") == root
    gone = s["entries"].where(mine).select(F.col("id").alias("entry_id")).withColumn("gone", F.lit(True))
    stops = F.col("gone").isNotNull() & _transfer(*S.UNSTARTED)
    rows = s["transfers"].join(gone, "entry_id", "left")
    code = F.lit(S.TRANSFER_STATE.index("cancelled"))
    stopped = rows.withColumns({"state": F.when(stops, code).otherwise(F.col("state")).cast(dict(s["transfers"].dtypes)["state"]), "updated_at": F.when(stops, F.lit(now)).otherwise(F.col("updated_at"))})
    return s.set("entries", mine, wanted=False).put("transfers", stopped.select(s["transfers"].columns))


WRITES: dict[str, Callable[..., Store]] = {
    "scanned.touch": lambda s, id, run: s.set("entries", F.col("id") == id, seen=run),
    "scanned.set_check": lambda s, id, check: s.set("entries", F.col("id") == id, check=S.MRA_CHECK.index(check)),
    "candidates.clear": lambda s, source: s.delete("candidates", F.col("source_id") == source),
    "offers.clear_matches": lambda s, source: s.set("offers", F.col("source_id") == source, item_id=None, confidence=None),
    "images.switch_waiting": lambda s, on: s.set("files", _is("reason", S.REASON, "off" if on else "pending"), reason=S.REASON.index("pending" if on else "off")),
    "images.recheck_layouts": lambda s, domain: s.set("files", (F.col("domain") == domain) & _is("reason", S.REASON, "no_layout"), reason=S.REASON.index("pending")),
    "images.set_reason_if": lambda s, id, was, to: s.set("files", (F.col("id") == id) & _is("reason", S.REASON, was), reason=S.REASON.index(to)),
    "versions.set_count": lambda s, id, count: s.set("versions", F.col("id") == id, entry_count=count),
    "transfers.move_all": lambda s, ids, to, now, error=None: s.set("transfers", F.col("id").isin(list(ids)), state=S.TRANSFER_STATE.index(to), updated_at=now, error=error),
    "files.move": lambda s, id, path, state, mtime: s.set("files", F.col("id") == id, rel_path=path, state=S.FILE_STATE.index(state), mtime=mtime),
    "files.delete": lambda s, id: s.delete("files", F.col("id") == id),
    "files.delete_paths": lambda s, domain, paths: s.delete("files", (F.col("domain") == domain) & F.col("rel_path").isin(list(paths))),
    "files.restamp": lambda s, id, mtime: s.set("files", F.col("id") == id, mtime=mtime),
    "files.reverify": lambda s, id, crc32: s.set("files", F.col("id") == id, state=S.FILE_STATE.index("unverified"), crc32=crc32, md5=None, sha1=None),
    "files.mark_verified": lambda s, id: s.set("files", (F.col("id") == id) & _is("state", S.FILE_STATE, "unverified"), state=S.FILE_STATE.index("verified")),
    "files.set_match": lambda s, id, item, state: s.set("files", F.col("id") == id, item_id=item, state=S.FILE_STATE.index(state)),
    "jobs.set_state": lambda s, id, to, now: s.set("jobs", F.col("id") == id, state=S.JOB_STATE.index(to), updated_at=now),
    "jobs.set_progress": lambda s, id, progress, now: s.set("jobs", F.col("id") == id, progress=progress, updated_at=now),
    "jobs.fail": lambda s, id, error, now: s.set("jobs", F.col("id") == id, state=S.JOB_STATE.index("failed"), progress=F.to_json(F.struct(F.lit(error).alias("error"))), updated_at=now),
    "jobs.requeue": lambda s, id, lane, now: s.set("jobs", F.col("id") == id, state=S.JOB_STATE.index("queued"), lane=lane, updated_at=now),
    "jobs.delete": lambda s, id: s.delete("jobs", F.col("id") == id),
    "domains.set_present": lambda s, slugs: s.put("domains", s["domains"].withColumn("present", F.col("slug").isin(list(slugs)))),
    "domains.set_enabled": lambda s, id, on: s.set("domains", F.col("id") == id, enabled=on),
    "sources.set_state": lambda s, id, to, reason=None: s.set("sources", F.col("id") == id, state=S.SOURCE_STATE.index(to), reason=reason),
    "sources.set_reason": lambda s, id, reason: s.set("sources", F.col("id") == id, reason=reason),
    "sources.suggest": lambda s, id, domain: s.set("sources", F.col("id") == id, suggested_domain=domain),
    "sources.bind": lambda s, id, domain, score: s.set("sources", F.col("id") == id, domain=domain, bind_score=score, state=S.SOURCE_STATE.index("bound")),
    "sources.user_binding": lambda s, id, on: s.set("sources", F.col("id") == id, user_binding=on),
    "sources.seed_policy": lambda s, id, policy, ratio=None: s.set("sources", F.col("id") == id, seed_policy=S.SEED_POLICY.index(policy), seed_ratio=ratio),
    "sources.set_client": lambda s, id, client: s.set("sources", F.col("id") == id, client_id=client),
    "sources.delete": lambda s, id: Store(s.delete("sources", F.col("id") == id).delete("offers", F.col("source_id") == id).delete("candidates", F.col("source_id") == id).tables),
    "scans.clear": lambda s, domain: s.delete("scans", F.col("domain") == domain),
    "entries.want": _want,
    "entries.unwant_group": _unwant_group,
}


def zip_items(items: DataFrame) -> DataFrame:
    """"dir/name" in ASCII lower case with its live items, a list each."""
    key = ascii_lower(F.concat_ws("/", "zip_dir", "name"))
    return items.where(_live()).groupBy(key.alias("path")).agg(F.array_sort(F.collect_list("id")).alias("items"))


def same_tracks(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """(image, stored_image): images whose whole track list, in order, equals a stored one."""
    digest = lambda df, name: df.groupBy(F.col("image").alias(name)).agg(F.array_sort(F.collect_list(F.struct("track", "sha1"))).alias("all"))
    pairs = digest(listed, "image").join(digest(stored, "stored_image"), "all")
    return first_per_key(pairs, ["image"], [F.col("stored_image")]).select("image", "stored_image")


def free_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (id, name) with a target nobody has: the name, or "stem (n).ext" with the first free n; in order of id among equal names.

    taken: name. Numbers in use are found by their stems, so nothing is tried one by one.
    """
    pattern = r"^(.*?)(?: \(([0-9]{1,9})\))?(\.[^.]*)?$"
    part = lambda c, k: F.regexp_extract(c, pattern, k)
    used = taken.select(part("name", 1).alias("stem"), part("name", 3).alias("ext"), F.coalesce(F.expr("try_cast(nullif(regexp_extract(name, '" + pattern.replace("\\", "\\\\") + "', 2), '') AS int)"), F.lit(0)).alias("k"))
    used = used.groupBy("stem", "ext").agg(F.collect_set("k").alias("used"))
    w = Window.partitionBy("stem", "ext").orderBy("id")
    rows = wanted.select("id", "name", F.regexp_replace("name", r"(\.[^.]*)?$", "").alias("whole"), part("name", 3).alias("ext")).withColumn("stem", F.col("whole"))
    rows = rows.join(used, ["stem", "ext"], "left").withColumn("place", F.row_number().over(w))
    used = F.coalesce("used", F.array().cast("array<int>"))
    room = F.sequence(F.lit(0), F.size(used) + F.col("place"))
    k = F.element_at(F.array_except(room, used), F.col("place"))
    return rows.select("id", F.when(k == 0, F.col("name")).otherwise(F.concat("stem", F.lit(" ("), k, F.lit(")"), "ext")).alias("target"))
