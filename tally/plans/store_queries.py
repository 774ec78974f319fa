"""Named queries of the store's reads and updates: a row for each, with the number of rows and a sum over them, against SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .catalogue import table
from .queries import query
from .reconcile import base, given
from .store import READS, WRITES, Store, free_names, same_tracks, zip_items

TABLES = ("entries", "versions", "items", "files", "transfers", "offers", "candidates", "jobs", "sources", "domains", "audit", "scans")
#: Tables that only these queries need, beside those of reconcile.
MORE = {
    "sources": ("supplier", "s_suppkey AS id, CONCAT('h', CAST(s_suppkey AS STRING)) AS infohash, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS domain, CAST(s_suppkey % 4 AS INT) AS state, s_suppkey % 5 = 0 AS user_binding, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS client_id, CAST(NULL AS STRING) AS reason, CAST(NULL AS BIGINT) AS suggested_domain, s_acctbal AS bind_score, CAST(0 AS INT) AS seed_policy, CAST(NULL AS DOUBLE) AS seed_ratio"),
    "domains": ("nation", "CAST(n_nationkey AS BIGINT) AS id, LOWER(n_name) AS slug, n_nationkey % 2 = 0 AS enabled"),
    "audit": ("orders", "o_orderkey AS id, o_orderkey AS transfer_id, CAST(o_orderkey % 5 AS INT) AS action"),
    "scans": ("events", "user_id % 4 AS domain, event_type AS unit"),
}
#: Columns that the shared tables lack.
EXTRA = {
    "entries": "CONCAT('p/', CAST(id % 30 AS STRING)) AS path, CAST(NULL AS INT) AS check_code, CAST(NULL AS BIGINT) AS seen",
    "files": "CAST(CASE WHEN state = 5 THEN id % 4 END AS INT) AS reason, id AS mtime",
    "jobs": "CAST(id % 2 AS INT) AS lane, CAST(NULL AS STRING) AS progress",
    "transfers": "CAST(NULL AS STRING) AS error",
    "versions": "CAST(0 AS BIGINT) AS entry_count",
}


def store(spark, d) -> Store:
    out = {}
    for name in TABLES:
        if name in MORE:
            source, columns = MORE[name]
            out[name] = spark.sql(f"SELECT {columns} FROM {{t}}", t=table(spark, d, source))
        else:
            out[name] = base(spark, d, name)
            if name in EXTRA:
                out[name] = spark.sql(f"SELECT *, {EXTRA[name]} FROM {{t}}", t=out[name])
    out["entries"] = out["entries"].withColumnRenamed("check_code", "check")
    return Store(out)


def head() -> str:
    from .reconcile import BASE

    parts = []
    for name in TABLES:
        source, columns = MORE.get(name) or BASE[name]
        inner = f"SELECT {columns} FROM {source}"
        extra = f"SELECT *, {EXTRA[name].replace('check_code', 'check_')} FROM ({inner})" if name in EXTRA else inner
        parts.append(f"{name} AS ({extra})")
    return "WITH " + ", ".join(parts)


#: (name, parameters, summed expression, SQL of the same rows)
READ_CASES = [
    ("scanned.live_count", {"domain": 2}, "n", "SELECT count(*) AS n FROM entries WHERE source = 1 AND NOT retired AND domain = 2"),
    ("scanned.has_any", {"domain": 9}, "CAST(found AS INT)", "SELECT false AS found"),
    ("scanned.at_path", {"domain": 1, "path": "p/4"}, "id", "SELECT id FROM entries WHERE source = 1 AND NOT retired AND domain = 1 AND path = 'p/4' ORDER BY id LIMIT 1"),
    ("scanned.by_set_name", {"domain": 3, "name": "G7"}, "id", "SELECT id FROM entries WHERE domain = 3 AND name = 'g7' ORDER BY id LIMIT 1"),
    ("candidates.of_offer", {"source": 4, "index": 44}, "item_id", "SELECT * FROM candidates WHERE source_id = 4 AND file_index = 44"),
    ("candidates.of_range", {"source": 4, "first": 10, "last": 700}, "item_id", "SELECT * FROM candidates WHERE source_id = 4 AND file_index BETWEEN 10 AND 700"),
    ("candidates.guessed", {"source": 4, "index": 1, "item": 8}, "CAST(found AS INT)", "SELECT count(*) > 0 AS found FROM candidates WHERE source_id = 4 AND file_index = 1 AND item_id = 8"),
    ("offers.in_order", {"source": 3}, "file_index", "SELECT * FROM offers WHERE source_id = 3"),
    ("offers.path", {"source": 3, "index": 9}, "LENGTH(path)", "SELECT path FROM offers WHERE source_id = 3 AND file_index = 9"),
    ("offers.unmatched", {"source": 3}, "file_index", "SELECT * FROM offers WHERE source_id = 3 AND item_id IS NULL AND file_index NOT IN (SELECT file_index FROM candidates)"),
    ("images.waiting", {"reasons": ("pending", "off"), "after": 40, "limit": 25}, "id", "SELECT * FROM files WHERE state = 5 AND reason IN (0, 1) AND id > 40 ORDER BY id LIMIT 25"),
    ("images.waiting_count", {"reasons": ("pending",)}, "n", "SELECT count(*) AS n FROM files WHERE state = 5 AND reason = 1"),
    ("images.has_waiting", {"reasons": ("no_layout",), "domain": 2}, "CAST(found AS INT)", "SELECT count(*) > 0 AS found FROM files WHERE state = 5 AND reason = 2 AND domain = 2"),
    ("versions.get", {"id": 5}, "loaded_at", "SELECT * FROM versions WHERE id = 5"),
    ("transfers.get", {"id": 17}, "item_id", "SELECT * FROM transfers WHERE id = 17"),
    ("transfers.of_offer", {"source": 7, "index": 12}, "id", "SELECT * FROM transfers WHERE source_id = 7 AND file_index = 12 ORDER BY state <= 4 DESC, id DESC LIMIT 1"),
    ("transfers.of_source", {"source": 7, "states": ("done", "bad")}, "id", "SELECT * FROM transfers WHERE source_id = 7 AND state IN (5, 6)"),
    ("transfers.selected", {"source": 7}, "file_index", "SELECT DISTINCT file_index FROM transfers WHERE source_id = 7 AND state IN (1, 2, 3, 4)"),
    ("transfers.open_count", {"source": 7}, "n", "SELECT count(*) AS n FROM transfers WHERE source_id = 7 AND state IN (1, 2, 3, 4)"),
    ("transfers.of_entry", {"entry": 11}, "id", "SELECT * FROM transfers WHERE entry_id = 11"),
    ("transfers.finished", {}, "id", "SELECT * FROM transfers WHERE state > 4"),
    ("transfers.started", {}, "id", "SELECT * FROM transfers WHERE state IN (2, 3)"),
    ("transfers.placed_any", {"entry": 12}, "CAST(found AS INT)", "SELECT coalesce(bool_or(state = 5 OR (state = 6 AND id IN (SELECT transfer_id FROM audit WHERE action = 0))), false) AS found FROM transfers WHERE entry_id = 12"),
    ("files.get", {"id": 33}, "size", "SELECT * FROM files WHERE id = 33"),
    ("files.at_path", {"domain": 1, "path": "f/30"}, "id", "SELECT * FROM files WHERE domain = 1 AND rel_path = 'f/30'"),
    ("files.paths", {"domain": 1}, "LENGTH(rel_path)", "SELECT * FROM files WHERE domain = 1"),
    ("files.has_verified", {"item": 13}, "CAST(found AS INT)", "SELECT count(*) > 0 AS found FROM files WHERE item_id = 13 AND state = 1"),
    ("files.verified", {"item": 13}, "id", "SELECT * FROM files WHERE item_id = 13 AND state = 1 ORDER BY id LIMIT 1"),
    ("files.hashed", {}, "id", "SELECT * FROM files WHERE md5 IS NOT NULL AND sha1 IS NOT NULL"),
    ("files.misnamed", {}, "id", "SELECT f.id FROM files f JOIN items i ON i.id = f.item_id WHERE f.state = 2"),
    ("items.get", {"id": 50}, "size", "SELECT * FROM items WHERE id = 50"),
    ("items.live_of", {"entry": 21}, "id", "SELECT * FROM items WHERE entry_id = 21 AND NOT retired"),
    ("items.count_of", {"entry": 21}, "n", "SELECT count(*) AS n FROM items WHERE entry_id = 21"),
    ("items.entry_of", {"id": 50}, "entry_id", "SELECT * FROM items WHERE id = 50"),
    ("items.retired", {"id": 51}, "CAST(found AS INT)", "SELECT i.retired OR e.retired AS found FROM items i JOIN entries e ON e.id = i.entry_id WHERE i.id = 51"),
    ("items.sized", {"size": 31, "suffix": "1"}, "id", "SELECT * FROM items WHERE size = 31 AND ends_with(name, '1') AND NOT retired"),
    ("jobs.get", {"id": 9}, "kind", "SELECT * FROM jobs WHERE id = 9"),
    ("jobs.count_kind", {"kind": 3}, "n", "SELECT count(*) AS n FROM jobs WHERE kind = 3"),
    ("jobs.open", {}, "id", "SELECT * FROM jobs WHERE state <= 2"),
    ("jobs.queued_of_kind", {"kind": 3}, "id", "SELECT * FROM jobs WHERE kind = 3 AND state = 0"),
    ("jobs.open_in_lane", {"lane": 1}, "id", "SELECT * FROM jobs WHERE lane = 1 AND state <= 2"),
    ("jobs.other_in_lane", {"lane": 1, "kind": 3}, "CAST(found AS INT)", "SELECT count(*) > 0 AS found FROM jobs WHERE lane = 1 AND kind <> 3 AND state = 0"),
    ("domains.resolve", {"slug": "nation_3"}, "id", "SELECT * FROM domains WHERE slug = 'nation_3'"),
    ("domains.slug", {"id": 3}, "LENGTH(slug)", "SELECT * FROM domains WHERE id = 3"),
    ("domains.count", {}, "n", "SELECT count(*) AS n FROM domains"),
    ("domains.list", {}, "id", "SELECT * FROM domains"),
    ("domains.with_entries", {}, "domain", "SELECT DISTINCT domain FROM entries WHERE NOT retired"),
    ("domains.has_entries", {"domain": 4}, "CAST(found AS INT)", "SELECT count(*) > 0 AS found FROM entries WHERE NOT retired AND domain = 4"),
    ("sources.get", {"id": 8}, "state", "SELECT * FROM sources WHERE id = 8"),
    ("sources.by_infohash", {"infohash": "h8"}, "id", "SELECT * FROM sources WHERE infohash = 'h8'"),
    ("sources.resolving", {}, "id + CAST(in_client AS INT)", "SELECT id, client_id IS NOT NULL AS in_client FROM sources WHERE state = 0"),
    ("sources.unbound", {}, "id", "SELECT * FROM sources WHERE state = 1 AND NOT user_binding"),
    ("sources.of_domains", {"domains": [3, 4]}, "id", "SELECT * FROM sources WHERE domain IN (3, 4)"),
    ("sources.mapped", {}, "id", "SELECT * FROM sources WHERE domain IS NOT NULL"),
    ("sources.in_client", {}, "id", "SELECT * FROM sources WHERE client_id IS NOT NULL"),
    ("scans.done", {"domain": 2}, "LENGTH(unit)", "SELECT * FROM scans WHERE domain = 2"),
    ("scans.domains", {}, "domain", "SELECT DISTINCT domain FROM scans"),
]

_CODE = "coalesce(CAST({0} AS BIGINT), -1) * (1 + id % 7)"
#: (name, parameters, table, summed expression, SQL of the table after the update)
WRITE_CASES = [
    ("scanned.touch", {"id": 4, "run": 9}, "entries", _CODE.format("seen"), "SELECT id, CASE WHEN id = 4 THEN 9 ELSE seen END AS seen FROM entries"),
    ("scanned.set_check", {"id": 4, "check": "refused"}, "entries", _CODE.format("`check`"), "SELECT id, CASE WHEN id = 4 THEN 1 END AS \"check\" FROM entries"),
    ("candidates.clear", {"source": 5}, "candidates", "item_id", "SELECT * FROM candidates WHERE source_id <> 5"),
    ("offers.clear_matches", {"source": 5}, "offers", "coalesce(item_id, -1) + coalesce(confidence, -1)", "SELECT CASE WHEN source_id <> 5 THEN item_id END AS item_id, CASE WHEN source_id <> 5 THEN confidence END AS confidence FROM offers"),
    ("images.switch_waiting", {"on": True}, "files", _CODE.format("reason"), "SELECT id, CASE WHEN reason = 0 THEN 1 ELSE reason END AS reason FROM files"),
    ("images.recheck_layouts", {"domain": 3}, "files", _CODE.format("reason"), "SELECT id, CASE WHEN reason = 2 AND domain = 3 THEN 1 ELSE reason END AS reason FROM files"),
    ("images.set_reason_if", {"id": 5, "was": "pending", "to": "corrupt"}, "files", _CODE.format("reason"), "SELECT id, CASE WHEN reason = 1 AND id = 5 THEN 14 ELSE reason END AS reason FROM files"),
    ("versions.set_count", {"id": 3, "count": 70}, "versions", _CODE.format("entry_count"), "SELECT id, CASE WHEN id = 3 THEN 70 ELSE entry_count END AS entry_count FROM versions"),
    ("transfers.move_all", {"ids": [3, 4, 5], "to": "bad", "now": 99, "error": "x"}, "transfers", _CODE.format("state * 1000 + updated_at + coalesce(LENGTH(error), 0)"), "SELECT id, CASE WHEN id IN (3, 4, 5) THEN 6 ELSE state END AS state, CASE WHEN id IN (3, 4, 5) THEN 99 ELSE updated_at END AS updated_at, CASE WHEN id IN (3, 4, 5) THEN 'x' END AS error FROM transfers"),
    ("files.move", {"id": 6, "path": "new", "state": "verified", "mtime": 1}, "files", _CODE.format("state + mtime + LENGTH(rel_path)"), "SELECT id, CASE WHEN id = 6 THEN 1 ELSE state END AS state, CASE WHEN id = 6 THEN 1 ELSE mtime END AS mtime, CASE WHEN id = 6 THEN 'new' ELSE rel_path END AS rel_path FROM files"),
    ("files.delete", {"id": 6}, "files", "id", "SELECT * FROM files WHERE id <> 6"),
    ("files.delete_paths", {"domain": 1, "paths": ["f/30", "f/31"]}, "files", "id", "SELECT * FROM files WHERE NOT (domain = 1 AND rel_path IN ('f/30', 'f/31'))"),
    ("files.restamp", {"id": 6, "mtime": 5}, "files", "mtime", "SELECT CASE WHEN id = 6 THEN 5 ELSE mtime END AS mtime FROM files"),
    ("files.reverify", {"id": 35, "crc32": 1}, "files", _CODE.format("state + coalesce(crc32, 0) + coalesce(md5, 500)"), "SELECT id, CASE WHEN id = 35 THEN 3 ELSE state END AS state, CASE WHEN id = 35 THEN 1 ELSE crc32 END AS crc32, CASE WHEN id <> 35 THEN md5 END AS md5 FROM files"),
    ("files.mark_verified", {"id": 9}, "files", _CODE.format("state"), "SELECT id, CASE WHEN id = 9 AND state = 3 THEN 1 ELSE state END AS state FROM files"),
    ("files.set_match", {"id": 9, "item": 2, "state": "bad"}, "files", _CODE.format("state + coalesce(item_id, 0)"), "SELECT id, CASE WHEN id = 9 THEN 4 ELSE state END AS state, CASE WHEN id = 9 THEN 2 ELSE item_id END AS item_id FROM files"),
    ("jobs.set_state", {"id": 9, "to": "done", "now": 1}, "jobs", _CODE.format("state + updated_at"), "SELECT id, CASE WHEN id = 9 THEN 3 ELSE state END AS state, CASE WHEN id = 9 THEN 1 ELSE updated_at END AS updated_at FROM jobs"),
    ("jobs.set_progress", {"id": 9, "progress": "{}", "now": 1}, "jobs", _CODE.format("coalesce(LENGTH(progress), 0) + updated_at"), "SELECT id, CASE WHEN id = 9 THEN '{}' END AS progress, CASE WHEN id = 9 THEN 1 ELSE updated_at END AS updated_at FROM jobs"),
    ("jobs.fail", {"id": 9, "error": "no", "now": 1}, "jobs", _CODE.format("coalesce(LENGTH(progress), 0) + state"), "SELECT id, CASE WHEN id = 9 THEN '{\"error\":\"no\"}' END AS progress, CASE WHEN id = 9 THEN 4 ELSE state END AS state FROM jobs"),
    ("jobs.requeue", {"id": 9, "lane": 0, "now": 1}, "jobs", _CODE.format("lane + state"), "SELECT id, CASE WHEN id = 9 THEN 0 ELSE lane END AS lane, CASE WHEN id = 9 THEN 0 ELSE state END AS state FROM jobs"),
    ("jobs.delete", {"id": 9}, "jobs", "id", "SELECT * FROM jobs WHERE id <> 9"),
    ("domains.set_present", {"slugs": ["nation_1", "nation_2"]}, "domains", _CODE.format("CAST(present AS INT)"), "SELECT id, slug IN ('nation_1', 'nation_2') AS present FROM domains"),
    ("domains.set_enabled", {"id": 2, "on": False}, "domains", _CODE.format("CAST(enabled AS INT)"), "SELECT id, CASE WHEN id = 2 THEN false ELSE enabled END AS enabled FROM domains"),
    ("sources.set_state", {"id": 8, "to": "disabled", "reason": "r"}, "sources", _CODE.format("state + coalesce(LENGTH(reason), 0)"), "SELECT id, CASE WHEN id = 8 THEN 3 ELSE state END AS state, CASE WHEN id = 8 THEN 'r' ELSE reason END AS reason FROM sources"),
    ("sources.set_reason", {"id": 8, "reason": "why"}, "sources", _CODE.format("LENGTH(reason)"), "SELECT id, CASE WHEN id = 8 THEN 'why' ELSE reason END AS reason FROM sources"),
    ("sources.suggest", {"id": 8, "domain": 4}, "sources", _CODE.format("suggested_domain"), "SELECT id, CASE WHEN id = 8 THEN 4 END AS suggested_domain FROM sources"),
    ("sources.bind", {"id": 8, "domain": 4, "score": 1.0}, "sources", _CODE.format("state + coalesce(domain, 0)"), "SELECT id, CASE WHEN id = 8 THEN 2 ELSE state END AS state, CASE WHEN id = 8 THEN 4 ELSE domain END AS domain FROM sources"),
    ("sources.user_binding", {"id": 8, "on": True}, "sources", _CODE.format("CAST(user_binding AS INT)"), "SELECT id, user_binding OR id = 8 AS user_binding FROM sources"),
    ("sources.seed_policy", {"id": 8, "policy": "ratio", "ratio": 2.0}, "sources", _CODE.format("seed_policy + coalesce(seed_ratio, 0)"), "SELECT id, CASE WHEN id = 8 THEN 1 ELSE seed_policy END AS seed_policy, CASE WHEN id = 8 THEN 2 END AS seed_ratio FROM sources"),
    ("sources.set_client", {"id": 9, "client": "c"}, "sources", _CODE.format("LENGTH(client_id)"), "SELECT id, CASE WHEN id = 9 THEN 'c' ELSE client_id END AS client_id FROM sources"),
    ("sources.delete", {"id": 8}, "offers", "file_index", "SELECT * FROM offers WHERE source_id <> 8"),
    ("scans.clear", {"domain": 1}, "scans", "domain", "SELECT * FROM scans WHERE domain <> 1"),
    ("entries.unwant_group", {"root": 33, "now": 7}, "transfers", _CODE.format("state"), "SELECT t.id, CASE WHEN t.state <= 1 AND e.group_root = 33 THEN 8 ELSE t.state END AS state FROM transfers t LEFT JOIN entries e ON e.id = t.entry_id"),
]


def _row(op: str, df, value: str):
    return df.select(F.expr(f"CAST({value} AS BIGINT)").alias("v")).agg(F.count("*").alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("total")).select(F.lit(op).alias("op"), "n", "total")


def _sql(op: str, rows: str, value: str) -> str:
    return f"SELECT '{op}' AS op, count(*) AS n, coalesce(sum(({value.replace('`', chr(34))})::BIGINT), 0)::BIGINT AS total FROM ({rows})"


@query(head() + " " + " UNION ALL ".join(_sql(op, rows, value) for op, _, value, rows in READ_CASES))
def store_reads(spark, d):
    s = store(spark, d)
    return reduce(lambda a, b: a.unionByName(b), (_row(op, READS[op](s, **kw), value) for op, kw, value, _ in READ_CASES))


@query(head() + " " + " UNION ALL ".join(_sql(op, rows, value) for op, _, _, value, rows in WRITE_CASES))
def store_writes(spark, d):
    s = store(spark, d)
    return reduce(lambda a, b: a.unionByName(b), (_row(op, WRITES[op](s, **kw)[name], value) for op, kw, name, value, _ in WRITE_CASES))


@query(head() + " SELECT id, wanted OR (id = 45 AND NOT retired AND id % 6 <> 3) OR (id = 46 AND NOT retired AND id % 6 <> 3) AS wanted FROM entries")
def want_entries(spark, d):
    """Marked wanted unless retired or a BIOS."""
    s = store(spark, d)
    bios = s["entries"].where("id % 6 = 3").select(F.col("id").alias("entry_id"))
    return WRITES["entries.want"](WRITES["entries.want"](s, 45, bios), 46, bios)["entries"].select("id", "wanted")


@query(f"{given('items')} SELECT 'd' || (size % 3) || '/' || name AS path, list(id ORDER BY id) AS items FROM items WHERE NOT retired GROUP BY 1")
def live_zip_items(spark, d):
    return zip_items(base(spark, d, "items").withColumns({"zip_dir": F.concat(F.lit("D"), F.col("size") % 3), "name": F.upper("name")}))


@query("WITH t AS (SELECT o_custkey AS image, o_orderkey AS track, o_orderkey % 3 AS sha1 FROM orders WHERE o_orderkey < 300), l AS (SELECT image, list((track % 4, sha1) ORDER BY track % 4, sha1) AS a FROM t WHERE image % 2 = 0 GROUP BY 1), s AS (SELECT image, list((track % 4, sha1) ORDER BY track % 4, sha1) AS a FROM t WHERE image % 2 = 1 GROUP BY 1) SELECT l.image, min(s.image) AS stored_image FROM l JOIN s USING (a) GROUP BY 1")
def same_track_lists(spark, d):
    t = table(spark, d, "orders").where("o_orderkey < 300").select(F.col("o_custkey").alias("image"), (F.col("o_orderkey") % 4).alias("track"), (F.col("o_orderkey") % 3).alias("sha1"))
    return same_tracks(t.where("image % 2 = 1"), t.where("image % 2 = 0"))


@query("WITH w AS (SELECT p_partkey AS id, p_brand AS stem, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_partkey < 400) SELECT id, CASE WHEN f = 0 THEN stem || '.bin' ELSE stem || ' (' || f || ').bin' END AS target FROM (SELECT *, CASE WHEN stem = 'Brand#1' THEN k + (k >= 2)::INT ELSE k - 1 END AS f FROM w)")
def free_file_names(spark, d):
    """One stem has its plain name and number 2 taken already."""
    wanted = table(spark, d, "part").where("p_partkey < 400").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".bin")).alias("name"))
    taken = spark.createDataFrame([("Brand#1.bin",), ("Brand#1 (2).bin",), ("other.bin",)], "name string")
    return free_names(wanted, taken)
