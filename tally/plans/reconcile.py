"""Named queries of loads, transfers, jobs and lifecycles, each with DuckDB SQL of the same rows.

The test tables are read as tables of a catalogue: one list of expressions for
each, which Spark and DuckDB both understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, groups, lifecycle, loads, relational
from . import views
from .catalogue import table
from .queries import query

BASE = {
    "entries": ("part", "p_partkey AS id, CAST(p_size % 5 AS BIGINT) AS domain, p_partkey % 7 AS version_id, concat('g', CAST(p_partkey % 120 AS STRING)) AS name, p_name AS group_key, CAST(CASE WHEN p_partkey % 5 = 4 THEN 1 ELSE 0 END AS INT) AS source, p_partkey % 4 <> 1 AS wanted, p_partkey % 3 = 0 AS is_pick, p_partkey % 11 = 10 AS retired, p_partkey - p_partkey % 3 AS group_root"),
    "versions": ("nation", "CAST(n_nationkey AS BIGINT) AS id, concat('f', CAST(n_nationkey % 3 AS STRING)) AS family, CAST(n_nationkey * 7 % 25 AS BIGINT) AS loaded_at, n_name AS name"),
    "items": ("orders", "o_orderkey AS id, o_custkey % 150 AS entry_id, concat('r', CAST(o_orderkey % 40 AS STRING)) AS name, o_orderkey * 31 % 50 AS size, o_orderkey % 60 AS crc32, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 END AS md5, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 70 END AS sha1, CAST(o_orderkey % 4 AS INT) AS status, o_orderkey % 13 = 12 AS retired"),
    "files": ("events", "event_id AS id, user_id % 5 AS domain, user_id AS directory, concat('f/', CAST(event_id AS STRING)) AS rel_path, CASE WHEN event_id % 4 <> 3 THEN event_id % 700 END AS item_id, event_id * 31 % 50 AS size, event_id % 60 AS crc32, CASE WHEN event_id % 7 = 0 THEN event_id % 90 END AS md5, CASE WHEN event_id % 5 = 0 THEN event_id % 70 END AS sha1, CAST(CASE WHEN event_id % 6 = 0 THEN 6 ELSE 0 END AS INT) AS header_rule, CAST(event_id % 6 AS INT) AS state"),
    "transfers": ("orders", "o_orderkey AS id, o_custkey AS entry_id, o_orderkey - o_orderkey % 4 AS item_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 20 END AS source_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 50 END AS file_index, CAST(o_orderkey % 9 AS INT) AS state, CAST(o_orderkey % 101 AS DOUBLE) / 100 AS progress, o_orderkey AS updated_at"),
    "offers": ("events", "user_id % 20 AS source_id, event_id AS file_index, concat('d/', event_type, CAST(event_id AS STRING)) AS path, CASE WHEN event_id % 3 <> 2 THEN event_id * 4 % 1500 END AS item_id, CAST(CASE WHEN event_id % 3 <> 2 THEN event_id % 5 END AS INT) AS confidence"),
    "candidates": ("events", "user_id % 20 AS source_id, event_id AS file_index, event_id * 8 % 1500 AS item_id, CAST(3 AS INT) AS confidence"),
    "jobs": ("events", "event_id AS id, user_id % 6 AS kind, event_type AS subject, props AS payload, CAST(event_id % 5 AS INT) AS state, event_id AS updated_at"),
    "ops": ("customer", "c_custkey AS op, c_custkey * 100 AS since, CAST(c_custkey % 25 AS INT) AS tries"),
}


def base(spark: SparkSession, d: str, name: str) -> DataFrame:
    source, columns = BASE[name]
    return spark.sql(f"SELECT {columns} FROM {{t}}", t=table(spark, d, source))


def given(*names: str) -> str:
    """The same tables as the head of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {BASE[n][1]} FROM {BASE[n][0]})" for n in names)


BEST_SQL = "best AS (SELECT item_id, source_id AS best_source, file_index AS best_index FROM offers WHERE item_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY confidence, source_id, file_index) = 1)"
NOW = 1_000_000


def _best(spark, d):
    return lifecycle.best_offers(base(spark, d, "offers"), [F.col("confidence"), F.col("source_id"), F.col("file_index")])


# transfers ---------------------------------------------------------------------


@query(f"{given('transfers', 'offers')}, {BEST_SQL} SELECT id, CASE WHEN m THEN 1 ELSE state END::INT AS state, CASE WHEN m THEN best_source ELSE source_id END AS source_id, CASE WHEN m THEN best_index ELSE file_index END AS file_index, CASE WHEN m THEN 1000000 ELSE updated_at END::BIGINT AS updated_at FROM (SELECT t.*, b.* EXCLUDE (item_id), state = 0 AND best_source IS NOT NULL AS m FROM transfers t LEFT JOIN best b ON b.item_id = t.item_id)")
def promote_waiting(spark, d):
    return lifecycle.promote(base(spark, d, "transfers"), _best(spark, d), NOW).select("id", "state", "source_id", "file_index", F.col("updated_at").cast("long").alias("updated_at"))


_ASKED = "asked AS (SELECT DISTINCT c_custkey * 3 AS id FROM customer)"


def _asked(spark, d):
    return table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("id"))


@query(f"{given('transfers')}, {_ASKED} SELECT a.id, CASE WHEN t.id IS NULL THEN 'missing' WHEN state <> 7 THEN 'not_failed' WHEN EXISTS (SELECT 1 FROM transfers o WHERE o.item_id = t.item_id AND o.state <= 4) THEN 'busy' ELSE 'queued' END AS outcome FROM asked a LEFT JOIN transfers t ON t.id = a.id")
def retry_outcomes(spark, d):
    return lifecycle.retry(base(spark, d, "transfers"), _asked(spark, d))


@query(f"{given('transfers')}, {_ASKED} SELECT a.id, CASE WHEN t.id IS NULL THEN 'missing' WHEN state <= 3 THEN 'cancelled' ELSE 'final' END AS outcome, coalesce(state IN (2, 3), false) AS started FROM asked a LEFT JOIN transfers t ON t.id = a.id")
def cancel_outcomes(spark, d):
    return lifecycle.cancel(base(spark, d, "transfers"), _asked(spark, d))


@query(f"{given('transfers', 'entries')} SELECT t.id, source_id, state IN (2, 3) AS started FROM transfers t JOIN entries e ON e.id = t.entry_id WHERE group_root = 33 AND state <= 3")
def cancel_group(spark, d):
    return lifecycle.cancel_where(base(spark, d, "transfers"), base(spark, d, "entries"), F.col("group_root") == 33)


@query(f"{given('transfers', 'entries')} SELECT t.id, source_id, false AS started FROM transfers t JOIN entries e ON e.id = t.entry_id WHERE version_id = 3 AND state <= 1")
def cancel_unstarted_in_version(spark, d):
    from .. import schema as S

    return lifecycle.cancel_where(base(spark, d, "transfers"), base(spark, d, "entries"), F.col("version_id") == 3, S.UNSTARTED)


@query(f"{given('transfers', 'entries', 'files', 'offers')}, {BEST_SQL} SELECT DISTINCT t.entry_id, t.item_id, CASE WHEN best_source IS NULL THEN 'wanted' ELSE 'queued' END AS state, best_source AS source_id, best_index AS file_index FROM transfers t JOIN entries e ON e.id = t.entry_id LEFT JOIN best b ON b.item_id = t.item_id WHERE t.state = 6 AND e.wanted AND NOT e.retired AND NOT EXISTS (SELECT 1 FROM files f WHERE f.item_id = t.item_id AND f.state = 1) AND NOT EXISTS (SELECT 1 FROM transfers o WHERE o.item_id = t.item_id AND o.state <= 4)")
def want_again(spark, d):
    t = base(spark, d, "transfers")
    return lifecycle.want_again(t, t, base(spark, d, "entries"), base(spark, d, "files"), _best(spark, d))


@query(f"{given('transfers', 'offers')} SELECT DISTINCT t.id FROM transfers t JOIN offers o ON o.item_id = t.item_id WHERE o.confidence = 0 AND t.state <= 3 AND NOT (t.source_id IS NOT DISTINCT FROM o.source_id AND t.file_index IS NOT DISTINCT FROM o.file_index)")
def settle_elsewhere_redundant(spark, d):
    return lifecycle.redundant(base(spark, d, "transfers"), base(spark, d, "offers").where("confidence = 0").select("item_id", "source_id", "file_index"))


_MOVES = {"queued": ("transferring", "failed"), "transferring": ("checking", "failed", "queued"), "checking": ("importing", "bad"), "importing": ("done",)}


@query(f"""{given('transfers')}, seen AS (SELECT event_id AS id, (event_id + 1) % 9 AS goal, value AS got FROM events WHERE event_id % 3 = 1),
x AS (SELECT t.*, goal, got, coalesce((state, goal) IN ((1, 1), (1, 2), (1, 7), (2, 2), (2, 3), (2, 7), (2, 1), (3, 3), (3, 4), (3, 6), (4, 4), (4, 5)), false) AS m FROM transfers t LEFT JOIN seen s ON s.id = t.id)
SELECT id, CASE WHEN m THEN goal ELSE state END::INT AS state, CASE WHEN m THEN got ELSE progress END AS progress FROM x""")
def observed_transfers(spark, d):
    seen = table(spark, d, "events").where("event_id % 3 = 1").select(F.col("event_id").alias("id"), ((F.col("event_id") + 1) % 9).cast("int").alias("to"), F.col("value").alias("at"))
    return lifecycle.observe(base(spark, d, "transfers"), seen, _MOVES).select("id", F.col("state").cast("int").alias("state"), "progress")


# offers and proofs -----------------------------------------------------------------

_PROOFS = "proofs AS (SELECT source_id, file_index, file_index * 12 % 1500 AS item_id FROM offers WHERE file_index % 7 = 0)"


def _proofs(spark, d):
    return base(spark, d, "offers").where("file_index % 7 = 0").select("source_id", "file_index", (F.col("file_index") * 12 % 1500).alias("item_id"))


@query(f"{given('offers')}, {_PROOFS} SELECT o.source_id, o.file_index, coalesce(p.item_id, o.item_id) AS item_id, CASE WHEN p.item_id IS NULL THEN confidence ELSE 0 END AS confidence FROM offers o LEFT JOIN proofs p USING (source_id, file_index)")
def prove_offers(spark, d):
    after, _ = lifecycle.prove(base(spark, d, "offers"), base(spark, d, "candidates"), _proofs(spark, d))
    return after.select("source_id", "file_index", "item_id", F.col("confidence").cast("int").alias("confidence"))


@query(f"{given('offers', 'candidates')}, {_PROOFS} SELECT c.* FROM candidates c ANTI JOIN proofs p USING (source_id, file_index)")
def prove_drops_candidates(spark, d):
    return lifecycle.prove(base(spark, d, "offers"), base(spark, d, "candidates"), _proofs(spark, d))[1].select("source_id", "file_index", "item_id", "confidence")


@query(f"{given('offers', 'candidates')}, wrong AS (SELECT source_id, file_index, file_index * 4 % 1500 AS item_id FROM offers WHERE file_index % 4 = 0) SELECT 'offer' AS side, o.source_id, o.file_index, CASE WHEN w.item_id IS NULL THEN o.item_id END AS item_id FROM offers o LEFT JOIN wrong w ON (w.source_id, w.file_index, w.item_id) = (o.source_id, o.file_index, o.item_id) UNION ALL SELECT 'candidate', c.source_id, c.file_index, c.item_id FROM candidates c ANTI JOIN wrong w USING (source_id, file_index, item_id)")
def drop_pairs(spark, d):
    offers = base(spark, d, "offers")
    wrong = offers.where("file_index % 4 = 0").select("source_id", "file_index", (F.col("file_index") * 4 % 1500).alias("item_id"))
    o, c = lifecycle.drop_pairs(offers, base(spark, d, "candidates"), wrong)
    columns = ["source_id", "file_index", "item_id"]
    return o.select(F.lit("offer").alias("side"), *columns).unionByName(c.select(F.lit("candidate").alias("side"), *columns))


@query(f"{given('offers')}, live AS (SELECT DISTINCT c_custkey % 20 AS source_id, c_custkey * 4 AS item_id FROM customer) SELECT o.source_id, o.file_index, CASE WHEN gone THEN NULL ELSE o.item_id END AS item_id, CASE WHEN gone THEN NULL ELSE confidence END AS confidence FROM (SELECT o.*, coalesce(confidence = 0, false) AND NOT EXISTS (SELECT 1 FROM live l WHERE l.source_id = o.source_id AND l.item_id = o.item_id) AS gone FROM offers o) o")
def drop_foreign_proofs(spark, d):
    live = table(spark, d, "customer").select((F.col("c_custkey") % 20).alias("source_id"), (F.col("c_custkey") * 4).alias("item_id"))
    return lifecycle.drop_foreign_proofs(base(spark, d, "offers"), live).select("source_id", "file_index", "item_id", "confidence")


@query(f"{given('offers', 'candidates')}, stored AS (SELECT * FROM candidates WHERE file_index % 2 = 0), extra AS (SELECT source_id, file_index, item_id, 4::INT AS confidence FROM candidates WHERE file_index % 3 = 0), gone AS (SELECT source_id, file_index, item_id FROM candidates WHERE file_index % 10 = 0), bad AS (SELECT source_id, file_index, item_id FROM candidates WHERE file_index % 9 = 0), new AS (SELECT e.* FROM extra e SEMI JOIN (SELECT * FROM offers WHERE confidence IS DISTINCT FROM 0) o USING (source_id, file_index) ANTI JOIN bad b USING (source_id, file_index, item_id)) SELECT s.* FROM stored s ANTI JOIN gone g USING (source_id, file_index, item_id) ANTI JOIN new n USING (source_id, file_index, item_id) UNION ALL SELECT * FROM new")
def apply_candidate_diff(spark, d):
    c = base(spark, d, "candidates")
    add = c.where("file_index % 3 = 0").withColumn("confidence", F.lit(4))
    got = lifecycle.apply_candidates(base(spark, d, "offers"), c.where("file_index % 2 = 0"), add, c.where("file_index % 10 = 0"), c.where("file_index % 9 = 0"))
    return got.select("source_id", "file_index", "item_id", "confidence")


@query(f"{given('offers')} SELECT o.source_id, o.file_index, CASE WHEN o.file_index % 2 = 0 AND o.file_index % 6 <> 0 THEN o.file_index * 2 ELSE o.item_id END AS item_id FROM offers o")
def apply_match_diff(spark, d):
    offers = base(spark, d, "offers").withColumn("proven", F.col("file_index") % 6 == 0)
    change = offers.where("file_index % 2 = 0").select("source_id", "file_index", (F.col("file_index") * 2).alias("item_id"))
    return diff.apply_matches(offers, change, ["source_id", "file_index"], "item_id", "proven").select("source_id", "file_index", "item_id")


@query(f"{given('offers')} SELECT n.source_id, n.file_index, o.item_id FROM offers n LEFT JOIN (SELECT * FROM offers WHERE file_index % 4 <> 0) o ON o.source_id = n.source_id AND o.file_index = n.file_index AND o.path = n.path")
def replaced_list_keeps_proofs(spark, d):
    offers = base(spark, d, "offers")
    return diff.keep_proofs(offers.where("file_index % 4 <> 0"), offers, ["source_id", "file_index", "path"], ["item_id"]).select("source_id", "file_index", "item_id")


@query(f"{given('files')} SELECT id, CASE WHEN item_id % 10 = 3 THEN NULL ELSE item_id END AS item_id FROM files")
def references_nulled(spark, d):
    files = base(spark, d, "files")
    gone = files.where("item_id % 10 = 3").select(F.col("item_id").alias("id"))
    return diff.null_out(files, gone, "item_id", "id").select("id", "item_id")


# jobs, deferred work ------------------------------------------------------------------


@query(f"{given('jobs')} SELECT id, CASE WHEN id % 2 = 0 AND state = 0 THEN 1 ELSE state END AS state, CASE WHEN id % 2 = 0 AND state = 0 THEN 1000000 ELSE updated_at END AS updated_at FROM jobs")
def job_claim(spark, d):
    jobs = base(spark, d, "jobs")
    return lifecycle.claim(jobs, jobs.where("id % 2 = 0"), NOW).select("id", F.col("state").cast("int").alias("state"), F.col("updated_at").cast("long").alias("updated_at"))


@query(f"{given('jobs')} SELECT kind, subject, min(id) AS id FROM jobs WHERE state IN (0, 2) AND (kind, subject) IN (SELECT (user_id % 6, event_type) FROM events WHERE event_id % 40 = 0) GROUP BY ALL")
def job_find(spark, d):
    wanted = table(spark, d, "events").where("event_id % 40 = 0").select((F.col("user_id") % 6).alias("kind"), F.col("event_type").alias("subject"))
    return lifecycle.find_job(base(spark, d, "jobs"), wanted, ("queued", "paused"))


@query(f"{given('jobs')} SELECT id, CASE WHEN NOT ok THEN 'unreadable' WHEN k > 1 THEN 'dropped' WHEN kind IN (1, 2, 3) THEN 'requeued' ELSE 'failed' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY ok, kind, payload ORDER BY id) AS k FROM (SELECT *, kind <> 5 AND json_valid(payload) AS ok FROM jobs WHERE state <= 2))")
def job_reconcile(spark, d):
    readable = (F.col("kind") != 5) & F.try_parse_json("payload").isNotNull()
    return lifecycle.reconcile(base(spark, d, "jobs"), readable, F.col("kind").isin(1, 2, 3))


@query(f"{given('ops')} SELECT * FROM ops UNION ALL SELECT DISTINCT s_suppkey + 40, 1000000::BIGINT, 0::INT FROM supplier WHERE s_suppkey + 40 NOT IN (SELECT op FROM ops)")
def deferred_add(spark, d):
    return lifecycle.defer(base(spark, d, "ops"), table(spark, d, "supplier").select((F.col("s_suppkey") + 40).alias("op")), NOW)


@query(f"{given('ops')} SELECT op, since, (tries + (op % 2 = 0)::INT)::INT AS tries FROM ops WHERE op % 7 <> 0 AND NOT (op % 2 = 0 AND tries + 1 >= 20 AND 100000 - since >= 86400)")
def deferred_finish(spark, d):
    ops = base(spark, d, "ops")
    return lifecycle.finish(ops, ops.where("op % 7 = 0"), ops.where("op % 2 = 0"), 100_000).select("op", "since", F.col("tries").cast("int").alias("tries"))


# lifecycles ---------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'disabled' WHEN s_suppkey % 4 = 0 THEN 'resolving' WHEN s_nationkey < 12 THEN 'bound' ELSE 'unbound' END AS state FROM supplier")
def source_lifecycle(spark, d):
    s = table(spark, d, "supplier")
    files, domain = F.when(F.col("s_suppkey") % 4 != 0, F.col("s_suppkey")), F.when(F.col("s_nationkey") < 12, F.col("s_nationkey"))
    return s.select("s_suppkey", lifecycle.source_state(F.col("s_suppkey") % 9 != 0, files, domain).alias("state"))


@query(f"{given('files', 'items')} SELECT f.id, CASE WHEN f.id % 8 = 0 THEN 'pending' WHEN f.header_rule = 6 AND f.id % 12 = 6 THEN 'unidentified' WHEN i.id IS NULL THEN 'unverified' WHEN i.status = 1 THEN 'bad' WHEN f.id % 5 > 1 THEN 'verified' ELSE 'misnamed' END AS state FROM files f LEFT JOIN items i ON i.id = f.item_id")
def file_lifecycle(spark, d):
    items = base(spark, d, "items").select(F.col("id").alias("item_id"), F.lit(True).alias("has"), "status")
    rows = base(spark, d, "files").join(items, "item_id", "left")
    disc = F.col("header_rule") == 6
    return rows.select("id", lifecycle.file_state(F.col("id") % 8 != 0, disc, F.col("id") % 12 != 6, F.when(F.col("has"), F.col("item_id")), F.col("status"), F.col("id") % 5 > 1).alias("state"))


_SMALL = "small AS (SELECT id, id - id % 4 AS entry_id, CAST(id % 4 AS INT) AS status FROM items WHERE id % 4 < 1 + (id // 4) % 4)"


def _small(spark, d):
    """Entries of one to four items."""
    return base(spark, d, "items").where("id % 4 < 1 + ((id div 4) % 4)").select("id", (F.col("id") - F.col("id") % 4).alias("entry_id"), (F.col("id") % 4).cast("int").alias("status"))


@query(f"{given('items')}, {_SMALL}, members AS (SELECT o_orderkey - o_orderkey % 8 AS directory, s.id AS item_id, s.entry_id FROM orders LEFT JOIN small s ON s.id = o_orderkey WHERE o_orderkey % 3 <> 1), need AS (SELECT entry_id, count(*) AS need FROM small GROUP BY 1), total AS (SELECT directory, count(*) AS files FROM members GROUP BY 1), held AS (SELECT directory, entry_id, count(DISTINCT item_id) AS have, count(*) AS n FROM members WHERE item_id IS NOT NULL GROUP BY ALL), first AS (SELECT h.* FROM held h JOIN need USING (entry_id) WHERE have = need QUALIFY row_number() OVER (PARTITION BY directory ORDER BY entry_id) = 1) SELECT t.directory, f.entry_id, CASE WHEN f.entry_id IS NULL THEN 'unverified' WHEN n = files THEN 'verified' ELSE 'misnamed' END AS state FROM total t LEFT JOIN first f USING (directory)")
def directory_classification(spark, d):
    small = _small(spark, d)
    files = table(spark, d, "orders").where("o_orderkey % 3 <> 1").select((F.col("o_orderkey") - F.col("o_orderkey") % 8).alias("directory"), F.col("o_orderkey").alias("at"))
    members = files.join(small.select(F.col("id").alias("item_id"), "entry_id"), F.col("at") == F.col("item_id"), "left").select("directory", "item_id", "entry_id")
    return lifecycle.directory_states(members, ["directory"], small.select("entry_id", F.col("id").alias("item_id")))


@query(f"{given('items')}, {_SMALL}, tracks AS (SELECT o_custkey % 60 * 4 AS disc, o_custkey % 60 * 4 + k AS item_id FROM orders, (VALUES (0), (1), (2), (3)) v(k) WHERE o_orderkey < 400 AND k <= o_custkey % 4), t AS (SELECT DISTINCT * FROM tracks), n AS (SELECT disc, count(*) AS n FROM t GROUP BY 1), h AS (SELECT disc, entry_id, count(DISTINCT item_id) AS hit, bool_or(status = 1) AS spoilt FROM t JOIN small s ON s.id = t.item_id GROUP BY ALL), z AS (SELECT entry_id, count(*) AS size FROM small GROUP BY 1), f AS (SELECT h.* FROM h JOIN z USING (entry_id) JOIN n USING (disc) WHERE hit = n AND hit = size QUALIFY row_number() OVER (PARTITION BY disc ORDER BY entry_id) = 1) SELECT n.disc, f.entry_id, CASE WHEN f.entry_id IS NULL THEN 'unidentified' WHEN spoilt THEN 'bad' ELSE 'verified' END AS state FROM n LEFT JOIN f USING (disc)")
def disc_classification(spark, d):
    small = _small(spark, d).withColumnRenamed("id", "item_id")
    at = table(spark, d, "orders").where("o_orderkey < 400").select((F.col("o_custkey") % 60 * 4).alias("disc"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_custkey") % 4)).alias("k"))
    tracks = at.select("disc", (F.col("disc") + F.col("k")).alias("item_id")).distinct()
    return lifecycle.disc_states(tracks.select("disc").distinct(), tracks, small)


# loads -------------------------------------------------------------------------------


_LISTED = "listed AS (SELECT DISTINCT p_size % 5 AS domain, 'g' || (p_partkey * 7 % 150)::VARCHAR AS name FROM part)"


def _listed(spark, d):
    return table(spark, d, "part").select((F.col("p_size") % 5).cast("long").alias("domain"), F.concat(F.lit("g"), (F.col("p_partkey") * 7 % 150).cast("string")).alias("name")).distinct()


@query(f"{given('entries', 'versions')}, {_LISTED}, known AS (SELECT e.domain, e.name, e.id FROM entries e JOIN versions v ON v.id = e.version_id WHERE e.source = 0 AND v.family = 'f0' QUALIFY row_number() OVER (PARTITION BY e.domain, e.name ORDER BY v.id = 3 DESC, loaded_at DESC, e.id) = 1) SELECT coalesce(k.id, (SELECT max(id) FROM entries) + row_number() OVER (PARTITION BY k.id IS NULL ORDER BY l.domain, l.name)) AS id, l.domain::BIGINT AS domain, l.name, k.id IS NOT NULL AS existed, 3::BIGINT AS version_id FROM listed l LEFT JOIN known k ON k.domain = l.domain AND k.name = l.name")
def upsert_entries_in_family(spark, d):
    return loads.put_entries(_listed(spark, d), base(spark, d, "entries"), base(spark, d, "versions"), 3)


_NEW_ITEMS = "listed AS (SELECT DISTINCT entry_id, name, size + (entry_id % 2) AS size, crc32, md5, sha1 FROM items WHERE entry_id % 3 = 0 AND id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY entry_id, name ORDER BY id) = 1)"


def _new_items(spark, d):
    mine = relational.first_per_key(base(spark, d, "items").where("entry_id % 3 = 0 and id % 5 <> 0"), ["entry_id", "name"], [F.col("id")])
    return mine.select("entry_id", "name", (F.col("size") + F.col("entry_id") % 2).alias("size"), "crc32", "md5", "sha1")


@query(f"{given('items')}, {_NEW_ITEMS} SELECT *, false AS retired FROM listed UNION ALL SELECT entry_id, name, size, crc32, md5, sha1, true FROM items i WHERE entry_id IN (SELECT entry_id FROM listed) AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.entry_id = i.entry_id AND l.name = i.name)")
def upsert_entry_items(spark, d):
    return loads.put_items(_new_items(spark, d), base(spark, d, "items"))


@query(f"{given('items', 'files')}, {_NEW_ITEMS}, changed AS (SELECT DISTINCT i.id FROM items i JOIN listed l USING (entry_id, name) WHERE i.size IS DISTINCT FROM l.size OR i.crc32 IS DISTINCT FROM l.crc32 OR i.md5 IS DISTINCT FROM l.md5 OR i.sha1 IS DISTINCT FROM l.sha1) SELECT id, CASE WHEN hit THEN NULL ELSE item_id END AS item_id, CASE WHEN NOT hit THEN state WHEN sha1 IS NOT NULL OR md5 IS NOT NULL THEN 3 ELSE 0 END AS state FROM (SELECT *, coalesce(item_id IN (SELECT id FROM changed), false) AND NOT (header_rule = 6 AND sha1 IS NULL AND md5 IS NULL) AS hit FROM files)")
def unmatch_changed_items(spark, d):
    return loads.unmatch_changed(base(spark, d, "files"), base(spark, d, "items"), _new_items(spark, d)).select("id", "item_id", F.col("state").cast("int").alias("state"))


@query(f"{given('entries', 'items', 'transfers')}, mine AS (SELECT id FROM entries WHERE version_id = 2 AND source = 0) SELECT 'entry' AS side, id, retired OR id IN (FROM mine) AS retired, CASE WHEN id IN (FROM mine) THEN 0 ELSE is_pick::INT + 2 * wanted::INT END AS state FROM entries UNION ALL SELECT 'item', id, retired OR entry_id IN (FROM mine), 0 FROM items UNION ALL SELECT 'transfer', id, false, CASE WHEN state <= 1 AND entry_id IN (FROM mine) THEN 8 ELSE state END FROM transfers")
def retire_version_cascade(spark, d):
    e, i, t = loads.retire_version(base(spark, d, "entries"), base(spark, d, "items"), base(spark, d, "transfers"), 2, NOW)
    rows = e.select(F.lit("entry").alias("side"), "id", "retired", (F.col("is_pick").cast("int") + 2 * F.col("wanted").cast("int")).alias("state"))
    rows = rows.unionByName(i.select(F.lit("item").alias("side"), "id", "retired", F.lit(0).alias("state")))
    return rows.unionByName(t.select(F.lit("transfer").alias("side"), "id", F.lit(False).alias("retired"), F.col("state").cast("int").alias("state")))


_TAGS = "stored AS (SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY name) - 1 AS pos, name FROM (SELECT DISTINCT entry_id, name FROM items WHERE id % 4 = 0)), listed AS (SELECT entry_id, id AS pos, name FROM items WHERE entry_id % 2 = 0 AND id % 4 <> 1), dense AS (SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY pos) - 1 AS pos, name FROM (SELECT entry_id, name, min(pos) AS pos FROM listed GROUP BY ALL)), differ AS (SELECT entry_id FROM dense GROUP BY 1 HAVING list(name ORDER BY pos) IS DISTINCT FROM (SELECT list(name ORDER BY pos) FROM stored s WHERE s.entry_id = dense.entry_id))"


def _tags(spark, d):
    from pyspark.sql import Window

    items = base(spark, d, "items")
    stored = items.where("id % 4 = 0").select("entry_id", "name").distinct()
    stored = stored.withColumn("pos", F.row_number().over(Window.partitionBy("entry_id").orderBy("name")) - 1)
    return loads.put_tags(stored, items.where("entry_id % 2 = 0 and id % 4 <> 1").select("entry_id", F.col("id").alias("pos"), "name"), "entry_id", "pos", "name")


@query(f"{given('items')}, {_TAGS} SELECT entry_id, pos, name FROM stored WHERE entry_id NOT IN (FROM differ) UNION ALL SELECT entry_id, pos, name FROM dense WHERE entry_id IN (FROM differ)")
def replace_tag_lists(spark, d):
    return _tags(spark, d)[0].select("entry_id", F.col("pos").cast("long").alias("pos"), "name")


@query(f"{given('items')}, {_TAGS} SELECT entry_id FROM differ")
def changed_tag_lists(spark, d):
    return _tags(spark, d)[1]


@query(f"{given('files')}, stored AS (SELECT * FROM files WHERE id % 5 <> 0), listed AS (SELECT directory, rel_path, size + (id % 3 = 0)::INT AS size, crc32 FROM files WHERE directory % 2 = 0 AND id % 7 <> 0) SELECT coalesce(a.directory, b.directory) AS directory, coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN b.rel_path IS NULL THEN 'delete' ELSE 'write' END AS action FROM (SELECT * FROM stored WHERE directory IN (SELECT directory FROM listed)) a FULL JOIN listed b ON a.directory = b.directory AND a.rel_path = b.rel_path WHERE b.rel_path IS NULL OR a.rel_path IS NULL OR a.size IS DISTINCT FROM b.size OR a.crc32 IS DISTINCT FROM b.crc32")
def replace_container_rows(spark, d):
    files = base(spark, d, "files")
    listed = files.where("directory % 2 = 0 and id % 7 <> 0").select("directory", "rel_path", (F.col("size") + (F.col("id") % 3 == 0).cast("int")).alias("size"), "crc32")
    return loads.replace_container(files.where("id % 5 <> 0"), listed, ["directory"], "rel_path", ["size", "crc32"])


@query(f"{given('items', 'entries')}, signed AS (SELECT entry_id, list(k ORDER BY k) AS s FROM (SELECT entry_id, size AS k FROM items WHERE entry_id < 100 AND id < 400) GROUP BY 1), own AS (SELECT *, first_value(id) OVER (PARTITION BY domain, group_key ORDER BY version_id, id) AS parent FROM entries), l AS (SELECT o.*, s FROM own o LEFT JOIN signed ON entry_id = id), sh AS (SELECT domain, s, min(parent) AS anchor FROM l WHERE s IS NOT NULL GROUP BY ALL HAVING count(DISTINCT version_id) > 1), mv AS (SELECT parent, min(anchor) AS \"to\" FROM l JOIN sh USING (domain, s) WHERE anchor < parent GROUP BY 1), t AS (SELECT l.id, coalesce(\"to\", l.parent) AS target, retired FROM l LEFT JOIN mv ON mv.parent = l.parent), r AS (SELECT target, coalesce(CASE WHEN bool_or(id = target) THEN target END, min(id) FILTER (WHERE NOT retired), min(id)) AS root FROM t GROUP BY target) SELECT t.id, r.root FROM t JOIN r USING (target)")
def group_recompute(spark, d):
    items = base(spark, d, "items").where("entry_id < 100 and id < 400")
    return loads.recompute_groups(base(spark, d, "entries"), items, F.col("size"), [F.col("version_id"), F.col("id")])


@query(f"{given('items')}, layouts AS (SELECT DISTINCT id % 50 AS layout, id AS at, size FROM items WHERE id < 100), have AS (SELECT DISTINCT list(size ORDER BY size) AS s FROM (SELECT id - id % 2 AS entry_id, size FROM items WHERE NOT retired) GROUP BY entry_id) SELECT layout, list(size ORDER BY size) IN (SELECT s FROM have) AS known FROM layouts GROUP BY layout")
def layout_precheck(spark, d):
    items = base(spark, d, "items")
    live = items.where("not retired").select((F.col("id") - F.col("id") % 2).alias("entry_id"), "size")
    return loads.layout_known(live, items.where("id < 100").select((F.col("id") % 50).alias("layout"), "size"), "layout")


@query(f"{given('entries')} SELECT id, domain, source FROM entries g WHERE source = 1 OR domain NOT IN (SELECT domain FROM entries WHERE source = 1 AND NOT retired AND domain < 3)")
def alternative_catalogue_only(spark, d):
    e = base(spark, d, "entries")
    return loads.alternative_only(e, e.where("domain < 3"), F.col("source") == 1).select("id", "domain", "source")


@query(f"{given('files', 'items')}, hits AS (SELECT f.id AS file_id, i.id AS item_id, 0 AS tier FROM files f JOIN items i USING (sha1) WHERE NOT i.retired UNION ALL SELECT f.id, i.id, 1 FROM files f JOIN items i USING (md5) WHERE NOT i.retired UNION ALL SELECT f.id, i.id, 2 FROM files f JOIN items i ON i.crc32 = f.crc32 AND i.size = f.size WHERE NOT i.retired) SELECT file_id, item_id, tier::INT AS tier FROM hits QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY tier, item_id) = 1")
def rematch_stored_hashes(spark, d):
    return loads.rematch_stored(base(spark, d, "files"), base(spark, d, "items"))


@query(f"{given('files', 'items', 'entries')} SELECT f.id, f.item_id FROM files f JOIN items i ON i.id = f.item_id JOIN entries e ON e.id = i.entry_id WHERE i.retired OR e.retired")
def retired_matches(spark, d):
    return loads.retired_matches(base(spark, d, "files"), base(spark, d, "items"), base(spark, d, "entries")).select("id", "item_id")


@query(f"{given('entries')} SELECT a.id, b.id AS other FROM entries a JOIN entries b ON a.group_root = b.group_root WHERE NOT a.retired AND NOT b.retired AND a.version_id <> b.version_id")
def other_versions_of_group(spark, d):
    return loads.other_versions(base(spark, d, "entries"))


@query("SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS whole FROM lineitem GROUP BY 1")
def contiguous_numbers(spark, d):
    return loads.numbering_gaps(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 256 AS piece FROM orders WHERE o_orderstatus = 'F'")
def bounded_pieces(spark, d):
    return loads.pieces(table(spark, d, "orders").where("o_orderstatus = 'F'"), ["o_orderkey"], 256).select("o_orderkey", "piece")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) END AS key FROM part")
def derive_missing_keys(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 3 == 0, "kept").alias("key"))
    return loads.derive_keys(rows, "p_name", {"key": text.binding_name}).select("p_partkey", "key")


@query("SELECT p_partkey, lower(p_type) AS family FROM part WHERE p_partkey % 2 = 0 AND lower(p_type) IS DISTINCT FROM (CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) ELSE p_type END)")
def refresh_family_keys(spark, d):
    rows = table(spark, d, "part").where("p_partkey % 2 = 0").select("p_partkey", "p_type", F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("family"))
    return loads.refreshed(rows, "family", F.lower("p_type")).select("p_partkey", "family")


@query("SELECT c_name AS key, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE c_custkey::VARCHAR END AS value FROM customer WHERE c_custkey % 7 <> 0")
def settings_put_and_remove(spark, d):
    c = table(spark, d, "customer")
    stored = c.select(F.col("c_name").alias("key"), F.col("c_custkey").cast("string").alias("value"))
    changes = c.where("c_custkey % 5 = 0 or c_custkey % 7 = 0").select(F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("value"))
    return loads.put_settings(stored, changes)


@query("SELECT n_nationkey AS id, n_name AS name, n_regionkey + 1 AS kind, n_nationkey % 2 = 0 AS enabled FROM nation")
def schema_migration(spark, d):
    """Three steps from version 1: a renamed column, a shifted code, a new column."""
    steps = {
        1: lambda t: t.drop("n_nationkey"),
        2: lambda t: t.withColumnsRenamed({"n_nationkey": "id", "n_name": "name"}),
        3: lambda t: t.withColumn("kind", F.col("n_regionkey") + 1).drop("n_regionkey"),
        4: lambda t: t.withColumn("enabled", F.col("id") % 2 == 0),
    }
    return loads.migrate(table(spark, d, "nation"), 1, steps)


@query("SELECT * FROM (VALUES (0, 'REGION 0'), (1, 'AMERICA'), (2, 'ASIA'), (9, 'new')) v(key, name) UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey NOT IN (0, 1, 2, 9)")
def seed_fixed_keys(spark, d):
    seeds = spark.createDataFrame([(0, "REGION 0"), (1, "AMERICA"), (2, "ASIA"), (9, "new")], "key int, name string")
    stored = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return diff.upsert(stored, seeds, ["key"])


# sets, stamps, views -----------------------------------------------------------------


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def kept_keys(spark, d):
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def complement_of_selection(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.select("c_custkey").subtract(o.where("o_totalprice > 100000").select("o_custkey"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS queued, (SELECT count(DISTINCT o_custkey) FROM orders) AS holders, (SELECT count(*) > 0 FROM part WHERE p_size > 49) AS has_large, (SELECT count(*) > 0 FROM supplier WHERE s_suppkey < 0) AS has_none")
def existence_counts(spark, d):
    o = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("queued"), F.count_distinct("o_custkey").alias("holders"))
    has = lambda t, c, n: table(spark, d, t).agg((F.count_if(F.expr(c)) > 0).alias(n))
    return o.crossJoin(has("part", "p_size > 49", "has_large")).crossJoin(has("supplier", "s_suppkey < 0", "has_none"))  # one row each


@query(f"{given('files')} SELECT id, state_text, header_rule_text FROM (SELECT id, (['pending', 'verified', 'misnamed', 'unverified', 'bad', 'unidentified'])[state + 1] AS state_text, (['none', 'ines', 'smc', 'a78', 'lnx', 'n64', 'chd'])[header_rule + 1] AS header_rule_text FROM files)")
def file_view(spark, d):
    files = base(spark, d, "files").withColumns({"reason": F.lit(None).cast("int"), **{c: F.lit(None).cast("binary") for c in ("crc32", "md5", "sha1")}})
    domains = spark.createDataFrame([(0, "a")], "id bigint, slug string")
    return views.file_view(files, domains).select("id", "state_text", "header_rule_text")


@query(f"{given('items', 'entries')} SELECT i.id, e.name || i.name AS name, (['good', 'baddump', 'nodump', 'verified'])[status + 1] AS status_text, NOT i.retired AND NOT e.retired AS live, e.id % 4 = 1 AS bios FROM items i JOIN entries e ON e.id = i.entry_id")
def item_view(spark, d):
    items = base(spark, d, "items").withColumns({"own_name": F.lit(False), **{c: F.lit(None).cast("binary") for c in ("crc32", "md5", "sha1")}})
    entries = base(spark, d, "entries").withColumn("parent_id", F.lit(None).cast("long"))
    tags = entries.where("id % 4 = 1").select(F.col("id").alias("entry_id"), F.lit(0).alias("pos"), F.lit(7).cast("long").alias("tag_id"))
    return views.item_view(items, entries, tags, 7).select("id", "name", "status_text", "live", "bios")


@query(f"{given('items', 'entries')} SELECT i.id FROM items i JOIN entries e ON e.id = i.entry_id WHERE NOT i.retired AND NOT e.retired AND e.id % 4 <> 1")
def live_item_view(spark, d):
    items = base(spark, d, "items").withColumns({"own_name": F.lit(False), **{c: F.lit(None).cast("binary") for c in ("crc32", "md5", "sha1")}})
    entries = base(spark, d, "entries").withColumn("parent_id", F.lit(None).cast("long"))
    tags = entries.where("id % 4 = 1").select(F.col("id").alias("entry_id"), F.lit(0).alias("pos"), F.lit(7).cast("long").alias("tag_id"))
    return views.live_item_view(items, entries, tags, 7).select("id")


@query(f"{given('entries')} SELECT id, (['dat', 'mra'])[source + 1] AS source_text, CASE WHEN id % 5 < 4 THEN (['match', 'refused', 'missing_part', 'mismatch'])[id % 5 + 1] END AS check_text FROM entries")
def entry_view(spark, d):
    domains = spark.createDataFrame([(0, "a")], "id bigint, slug string")
    return views.entry_view(base(spark, d, "entries").withColumn("check", (F.col("id") % 5).cast("int")), domains).select("id", "source_text", "check_text")


@query(f"{given('offers')} SELECT source_id, file_index, (['hash', 'name', 'base', 'fuzzy', 'size'])[confidence + 1] AS confidence_text FROM offers")
def offer_view(spark, d):
    return views.offer_view(base(spark, d, "offers")).select("source_id", "file_index", "confidence_text")


@query(f"{given('items')} SELECT entry_id, list(name ORDER BY pos) AS regions FROM (SELECT entry_id, id AS pos, 'tag' || (id % 6) AS name FROM items WHERE id % 6 IN (1, 4)) GROUP BY 1")
def ordered_tag_lists(spark, d):
    tags = spark.createDataFrame([(k, k % 3, f"tag{k}", 1 << k) for k in range(6)], "id bigint, kind int, name string, bit bigint")
    links = base(spark, d, "items").select("entry_id", F.col("id").alias("pos"), (F.col("id") % 6).alias("tag_id"))
    return views.tag_lists(links, tags, "region")


@query(f"{given('items')} SELECT entry_id, coalesce(bit_or(1 << (id % 6)::INT) FILTER (WHERE id % 3 = 0), 0)::BIGINT AS flag_bits, coalesce(bit_or(1 << (id % 6)::INT) FILTER (WHERE id % 3 = 1), 0)::BIGINT AS region_bits FROM items GROUP BY 1")
def tag_masks(spark, d):
    tags = spark.createDataFrame([(k, k % 3, f"tag{k}", 1 << k) for k in range(6)], "id bigint, kind int, name string, bit bigint")
    links = base(spark, d, "items").select("entry_id", F.col("id").alias("pos"), (F.col("id") % 6).alias("tag_id"))
    return views.tag_masks(links, tags)


@query(f"{given('transfers')} SELECT source_id, file_index, id, state FROM transfers QUALIFY row_number() OVER (PARTITION BY source_id, file_index ORDER BY state <= 4 DESC, id DESC) = 1")
def latest_transfers(spark, d):
    return views.latest_transfers(base(spark, d, "transfers")).select("source_id", "file_index", "id", "state")


@query(f"{given('files', 'items')} SELECT f.id, CASE WHEN i.id IS NULL THEN 'unverified' WHEN i.status = 1 THEN 'bad' WHEN f.id % 3 = 0 THEN 'verified' ELSE 'misnamed' END AS state_text FROM files f LEFT JOIN items i ON i.id = f.item_id")
def matched_file_states(spark, d):
    return views.file_states(base(spark, d, "files"), base(spark, d, "items"), F.col("id") % 3 == 0).select("id", "state_text")


@query(f"{given('items')} SELECT entry_id, n, x, s FROM (SELECT entry_id, count(*) AS n, bit_xor(size) AS x, sum(size)::BIGINT AS s FROM items GROUP BY 1)")
def stamps_without_order(spark, d):
    """The operator's digest of sums, with the value itself in the place of its hash."""
    return groups.stamp(base(spark, d, "items"), ["entry_id"], "size", hashed=lambda *c: F.col(c[0]))


@query(f"{given('entries')} SELECT id, retired OR id % 4 <> 2 AS retired FROM entries")
def retire_unseen_in_run(spark, d):
    return diff.retire_unseen(base(spark, d, "entries").withColumn("seen", F.col("id") % 4), "seen", 2).select("id", "retired")


@query(f"{given('transfers')} SELECT id, CASE WHEN id % 3 = 0 AND state = 1 THEN 2 WHEN id % 3 = 0 AND state = 2 THEN 2 ELSE state END AS state FROM transfers")
def compare_and_set(spark, d):
    from ..operators.state import compare_and_set

    rows = base(spark, d, "transfers").select("id", F.concat(F.lit("s"), F.col("state").cast("string")).alias("state"))
    delta = rows.where("id % 3 = 0").select("id", F.lit("s1").alias("from"), F.lit("s2").alias("to"))
    out = compare_and_set(rows, delta, "id", "state", {"s1": ["s2"], "s2": ["s3"]})
    return out.select("id", F.substring("state", 2, 2).cast("int").alias("state"))
