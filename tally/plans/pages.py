"""Named queries of pages, requests, assignments and small predicates, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import hashing, text
from ..operators import bind, browse, groups, lifecycle, match, pick
from ..sources import synthetic
from ..streaming import streams
from . import api
from .catalogue import ENTRIES_SQL, entries, pick_order, stored, table
from .queries import query
from .reconcile import base, given
from .store_queries import head, store

#: Titles of the catalogue that the published browse figures are for.
PUBLISHED = 41_000


def _synthetic(spark, d):
    """The summary that pages read, kept while the session lasts: a row a group, with its variants' masks."""

    def build():
        t = synthetic.titles(spark, PUBLISHED)
        g = t.groupBy("root", "domain").agg(F.min("name").alias("name"), F.count_if("have").alias("have"), F.count_if("wanted").alias("wanted"), F.max("id").alias("newest_id"), F.count("*").alias("variants"), F.min("bit").alias("lean_flags"))
        masks = groups.mask_sets(t.withColumn("region_bit", F.lit(1).cast("long")), ["root", "domain"])
        return g.join(masks, ["root", "domain"])

    return stored(spark, d, "synthetic", build)


_SHOWN = f"WITH t AS ({synthetic.titles_sql(PUBLISHED)}), g AS (SELECT root, domain, min(name) AS name, count(*) FILTER (WHERE have) AS have FROM t GROUP BY ALL HAVING bool_or(bit & 4 = 0)) "


@query(_SHOWN + "SELECT root, domain, name, have FROM g WHERE contains(name, 'ka') ORDER BY lower(name), root LIMIT 100")
def browse_published_size(spark, d):
    shown = browse.browse(_synthetic(spark, d), None, ["root", "domain"], browse.Filter(search="KA", hidden=4), "name", "root", 100)
    return shown[0].select("root", "domain", "name", "have")


@query(_SHOWN + "SELECT count(*) AS total FROM g WHERE contains(name, 'ka')")
def browse_published_total(spark, d):
    return browse.browse(_synthetic(spark, d), None, ["root", "domain"], browse.Filter(search="KA", hidden=4), "name", "root", 100)[1]


@query(synthetic.titles_sql(5000, 7))
def synthetic_titles(spark, d):
    return synthetic.titles(spark, 5000, 7)


# pages ---------------------------------------------------------------------------------


@query(head() + ", hit AS (SELECT DISTINCT source_id AS id, file_index FROM (SELECT source_id, file_index FROM offers WHERE item_id IS NOT NULL UNION ALL SELECT source_id, file_index FROM candidates)) SELECT s.id, (['resolving', 'unbound', 'bound', 'disabled'])[state + 1] AS state_text, (SELECT count(*) FROM hit h WHERE h.id = s.id) AS matched FROM sources s ORDER BY bind_score DESC, s.id DESC LIMIT 40 OFFSET 10")
def sources_page(spark, d):
    s = store(spark, d)
    tables = s.tables | {"sources": s["sources"].withColumn("added_at", F.col("bind_score"))}
    return api.sources(tables, 40, 10)[0].select("id", "state_text", "matched")


@query(head() + ", m AS (SELECT o.*, item_id IS NOT NULL OR EXISTS (SELECT 1 FROM candidates c WHERE c.source_id = o.source_id AND c.file_index = o.file_index) AS matched FROM offers o WHERE source_id = 3 AND contains(lower(path), 'click')) SELECT file_index, matched FROM m WHERE matched ORDER BY file_index LIMIT 30")
def offers_page(spark, d):
    return api.offers(store(spark, d).tables, 3, matched=True, search="CLICK", limit=30)[0].select("file_index", "matched")


@query(head() + " SELECT id, state FROM transfers WHERE state IN (5, 6) ORDER BY updated_at DESC, id DESC LIMIT 50")
def transfers_page(spark, d):
    return api.transfers(store(spark, d).tables, ["done", "bad"], 50)[0].select("id", "state")


@query(head() + " SELECT count(*) AS total FROM transfers WHERE state IN (5, 6)")
def transfers_total(spark, d):
    return api.transfers(store(spark, d).tables, ["done", "bad"], 50)[1]


@query(head() + " SELECT id, CASE WHEN id % 3 = 0 AND state <= 3 THEN 8 ELSE state END AS state FROM transfers")
def cancel_request(spark, d):
    s = store(spark, d)
    return api.cancel(s.tables, s["transfers"].where("id % 3 = 0"), 5).select("id", F.col("state").cast("int").alias("state"))


@query(head() + " SELECT id, (['placed', 'replaced', 'quarantined', 'skipped_existing', 'renamed'])[action + 1] AS action_text FROM audit ORDER BY id DESC LIMIT 20")
def audit_page(spark, d):
    s = store(spark, d)
    return api.audit(s.tables | {"audit": s["audit"].withColumn("at", F.col("id"))}, 20)[0].select("id", "action_text")


@query(head() + " SELECT id, kind FROM jobs WHERE state <= 2 ORDER BY id LIMIT 60 OFFSET 20")
def active_jobs_page(spark, d):
    return api.active_jobs(store(spark, d).tables, 60, 20)[0].select("id", "kind")


@query(head() + ", o AS (SELECT *, (kind, state) IS DISTINCT FROM lag((kind, state)) OVER (PARTITION BY lane ORDER BY updated_at, id) AS fresh FROM jobs WHERE state > 2), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY lane ORDER BY updated_at, id) AS run FROM o) SELECT lane, kind, state, count(*) AS n FROM r GROUP BY lane, run, kind, state ORDER BY max((updated_at, id)) DESC LIMIT 10")
def recent_jobs(spark, d):
    return api.recent_jobs(store(spark, d).tables).select("lane", "kind", "state", "n")


@query(head() + " SELECT v.id, n.name AS newer FROM versions v LEFT JOIN versions n ON n.id = CASE WHEN v.id % 4 = 0 THEN v.id + 1 END ORDER BY v.loaded_at DESC, v.id DESC LIMIT 15")
def versions_page(spark, d):
    s = store(spark, d)
    v = s["versions"].withColumns({"superseded_by": F.when(F.col("id") % 4 == 0, F.col("id") + 1), "version": F.col("name")})
    return api.versions(s.tables | {"versions": v}, 15)[0].select("id", F.col("newer_version").alias("newer"))


@query(head() + " SELECT id, (['off', 'pending', 'no_layout', 'unreadable'])[reason + 1] AS reason_text FROM files WHERE domain = 2 AND state = 5 ORDER BY rel_path, id LIMIT 25")
def unidentified_page(spark, d):
    s = store(spark, d)
    files = s["files"].withColumns({c: F.col(c).cast("string").cast("binary") for c in ("crc32", "md5", "sha1")})
    return api.unidentified(s.tables | {"files": files}, 2, 25)[0].select("id", "reason_text")


@query(head() + ", g AS (SELECT domain AS id, count(*) AS groups FROM entries GROUP BY 1), f AS (SELECT domain AS id, count(*) FILTER (WHERE state = 1) AS verified, count(*) FILTER (WHERE state = 4) AS bad FROM files GROUP BY 1) SELECT d.id, coalesce(groups, 0) AS groups, coalesce(verified, 0) AS verified, coalesce(bad, 0) AS bad FROM domains d LEFT JOIN g USING (id) LEFT JOIN f USING (id) ORDER BY slug LIMIT 12")
def domains_page(spark, d):
    s = store(spark, d)
    g = s["entries"].select("domain", F.lit(1).alias("have"), F.lit(0).alias("wanted"))
    return api.domains(s.tables, g, 12)[0].select("id", "groups", "verified", "bad")


@query(head() + " SELECT e.id, CASE WHEN version_id = 2 THEN e.name NOT IN (SELECT name FROM entries WHERE id % 2 = 0) ELSE retired END AS retired FROM entries e")
def load_version_request(spark, d):
    s = store(spark, d)
    return api.load_version(s.tables, s["entries"].where("id % 2 = 0").select("name"), 2).select("id", "retired")


# assignments, binding, picks -------------------------------------------------------------


@query("WITH t AS (SELECT o_custkey AS disc, o_orderkey AS track FROM orders WHERE o_orderkey < 600), c AS (SELECT disc, track, e AS entry FROM t, (VALUES (0), (1), (2)) v(e) WHERE (track + e) % 3 <> 0), n AS (SELECT e AS entry, e + 1 AS n FROM (VALUES (0), (1), (2)) v(e)), w AS (SELECT disc, count(DISTINCT track) AS tracks FROM t GROUP BY 1), p AS (SELECT disc, entry, count(DISTINCT track) AS hit FROM c GROUP BY ALL) SELECT p.disc, min(entry)::INT AS entry FROM p JOIN w USING (disc) JOIN n USING (entry) WHERE hit = tracks AND n = tracks GROUP BY 1")
def all_or_nothing(spark, d):
    t = table(spark, d, "orders").where("o_orderkey < 600").select(F.col("o_custkey").alias("disc"), F.col("o_orderkey").alias("track"))
    c = t.select("disc", "track", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("entry")).where("(track + entry) % 3 != 0")
    n = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "entry int, n int")
    return match.all_or_nothing(c, t, "disc", "track", "entry", n)


@query("WITH p AS (SELECT o_custkey AS entry, o_orderkey AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), i AS (SELECT o_custkey AS entry, o_orderkey + 1000000 AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0) SELECT entry, payload, item FROM p JOIN i USING (entry, k)")
def assign_distinct(spark, d):
    """Payloads that fit every item of their entry: each takes the next one left."""
    o = table(spark, d, "orders").withColumn("size", F.lit(1))
    p = o.select(F.col("o_custkey").alias("entry"), F.col("o_orderkey").alias("payload"), "size", F.lit("p").alias("leaf"))
    i = o.where("o_orderkey % 3 != 0").select(F.col("o_custkey").alias("entry"), (F.col("o_orderkey") + 1_000_000).alias("item"), "size", F.lit("i").alias("leaf"))
    return match.assign_distinct(p, i, "entry", "payload", "item", ["size"], "leaf")


@query("WITH h AS (SELECT user_id, event_type, count(*) AS w FROM events GROUP BY ALL), t AS (SELECT *, max(w) OVER (PARTITION BY user_id) AS top FROM h) SELECT user_id, CASE WHEN count(*) = 1 THEN max(event_type) END AS event_type FROM t WHERE w = top GROUP BY 1")
def unanimous_hints(spark, d):
    return bind.unanimous(table(spark, d, "events").withColumn("w", F.lit(1)), "user_id", "event_type", "w")


@query(f"{given('offers')}, m AS (SELECT source_id, file_index, file_index % 5 AS domain, item_id, confidence AS tier FROM offers WHERE item_id IS NOT NULL) SELECT source_id, file_index, item_id FROM m WHERE domain = 2")
def map_to_domain(spark, d):
    rows = base(spark, d, "offers").where("item_id is not null").select("source_id", "file_index", (F.col("file_index") % 5).alias("domain"), "item_id", F.col("confidence").alias("tier"))
    return bind.map_to(rows, "domain", 2, ["source_id", "file_index"], [F.col("item_id")]).select("source_id", "file_index", "item_id")


@query(f"WITH {ENTRIES_SQL}, old AS (SELECT root, domain, CASE WHEN root % 5 = 0 THEN pick_id + 1 ELSE pick_id END AS old FROM picks WHERE root % 7 <> 0) SELECT p.root, p.domain, old, pick_id AS \"new\" FROM picks p LEFT JOIN old o ON o.root = p.root AND o.domain = p.domain WHERE old IS DISTINCT FROM pick_id")
def changed_picks(spark, d):
    now = pick.pick(entries(spark, d), ["root", "domain"], pick_order()).select("root", "domain", "entry")
    old = now.where("root % 7 != 0").withColumn("entry", F.when(F.col("root") % 5 == 0, F.col("entry") + 1).otherwise(F.col("entry")))
    return pick.store_picks(old, now, ["root", "domain"], "entry").select("root", "domain", "old", "new")


@query("WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0) SELECT o_custkey FROM ((FROM a EXCEPT ALL FROM b) UNION (FROM b EXCEPT ALL FROM a)) GROUP BY 1")
def changed_group_keys(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return groups.changed_keys(o.where("o_orderkey % 10 != 0").drop("o_orderkey"), o.where("o_orderkey % 7 != 0").drop("o_orderkey"), ["o_custkey"])


@query(f"{given('entries')} SELECT id, CASE WHEN id % 4 = 0 THEN group_root WHEN id % 4 = 1 THEN id - 1 ELSE id END AS root FROM entries")
def root_lookup(spark, d):
    rows = base(spark, d, "entries").select("id", F.when(F.col("id") % 4 == 0, F.col("group_root")).alias("a"), F.when(F.col("id") % 4 < 2, F.col("id") - 1).alias("b"))
    return rows.select("id", groups.root_of("a", "b", "id").alias("root"))


# predicates --------------------------------------------------------------------------------


@query(f"{given('transfers')} SELECT id, state IN (0, 1, 2, 3, 4) AS open FROM transfers WHERE state IN (1, 5, 8)")
def states_in_list(spark, d):
    rows = base(spark, d, "transfers").where(F.col("state").isin(S.codes(S.TRANSFER_STATE, ("queued", "done", "cancelled"))))
    return rows.select("id", F.col("state").isin(S.codes(S.TRANSFER_STATE, S.OPEN)).alias("open"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 4 = 0 THEN 1.0 ELSE least(l_quantity, 30 + l_linenumber % 4 - 1) / (30 + l_linenumber % 4 - 1) END::DOUBLE AS ratio FROM lineitem")
def progress_ratios(spark, d):
    size = F.when(F.col("l_linenumber") % 4 == 0, F.lit(0)).otherwise(29 + F.col("l_linenumber") % 4)
    rows = table(spark, d, "lineitem").withColumn("size", size)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", hashing.progress("l_quantity", "size").cast("double").alias("ratio"))


@query("SELECT p_partkey, p_partkey % 20 >= p_size % 20 AS newer FROM part")
def not_older(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("v1."), F.col("p_partkey") % 20).alias("a"), F.concat(F.lit("1-"), F.col("p_size") % 20).alias("b"))
    return rows.select("p_partkey", text.not_older("a", "b").alias("newer"))


@query("SELECT p_partkey, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN '2024.' || p_size WHEN 1 THEN 'v' || p_size END AS version FROM part")
def split_versions(spark, d):
    spelt = F.expr("concat(p_name, CASE p_partkey % 3 WHEN 0 THEN concat(' (2024.', p_size, ')') WHEN 1 THEN concat('  [v', p_size, ']') ELSE '' END)")
    rows = table(spark, d, "part").select("p_partkey", text.split_version(spelt).alias("v"))
    return rows.select("p_partkey", "v.name", "v.version")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '_x_' WHEN 1 THEN p_name END AS name FROM part")
def safe_file_names(spark, d):
    spelt = F.expr("CASE p_partkey % 3 WHEN 0 THEN concat(p_name, '/x:') WHEN 1 THEN concat(' ', p_name, '. ') ELSE ' . ' END")
    return table(spark, d, "part").select("p_partkey", text.safe_name(spelt).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ' (' || p_brand || ').bin' END AS tail, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' (' || p_brand || ').bin' ELSE 'other.bin' END AS whole FROM part")
def title_tails(spark, d):
    rows = table(spark, d, "part").withColumn("name", F.expr("CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, ' (', p_brand, ').bin') ELSE 'other.bin' END"))
    rows = rows.withColumn("tail", text.own_tail("p_name", "name"))
    return rows.select("p_partkey", "tail", text.compose_name("p_name", F.coalesce("tail", "name"), F.col("tail").isNull()).alias("whole"))


@query("SELECT p_partkey, [p_brand, 'Rev ' || p_size] AS tags, p_partkey % 2 = 0 AS bad, p_partkey % 2 = 0 AS lang FROM part")
def name_tags(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") (Rev "), F.col("p_size"), F.lit(")"))
    tag = F.when(F.col("p_partkey") % 2 == 0, "b2").otherwise("bx")
    code = F.when(F.col("p_partkey") % 2 == 0, "Pt-BR").otherwise("eng")
    return table(spark, d, "part").select("p_partkey", text.tags(name).alias("tags"), text.is_bad_dump(tag).alias("bad"), text.is_language_code(code).alias("lang"))


@query("WITH u AS (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT c_custkey AS user_id, coalesce(value, c_acctbal) AS value FROM customer LEFT JOIN u ON user_id = c_custkey")
def live_overlay(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return streams.latest_overlay(rows, table(spark, d, "events"), "user_id", "event_id", ["value"])


# jobs over many rows, small texts --------------------------------------------------------------


@query(f"{given('files', 'items')} SELECT f.id, CASE WHEN f.state = 2 AND i.id IS NOT NULL AND f.id % 3 = 0 THEN 1 ELSE f.state END AS state FROM files f LEFT JOIN items i ON i.id = f.item_id")
def settled_names(spark, d):
    return lifecycle.settle_names(base(spark, d, "files"), base(spark, d, "items"), F.col("id") % 3 == 0).select("id", F.col("state").cast("int").alias("state"))


@query(head() + ", sc AS (SELECT o_custkey % 100 AS id, o_orderkey % 7 AS domain, (o_orderkey % 5) / 5.0::DOUBLE AS score FROM orders), r AS (SELECT sc.*, sc.domain = s.id % 7 AS mine FROM sc JOIN sources s ON s.id = sc.id WHERE s.state = 1 AND NOT s.user_binding AND score >= 0.6) SELECT DISTINCT id, domain, score FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, mine DESC, domain) = 1")
def rebound_sources(spark, d):
    s = store(spark, d)
    scores = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("id"), (F.col("o_orderkey") % 7).alias("domain"), ((F.col("o_orderkey") % 5) / 5.0).alias("score"))
    return lifecycle.rebind(s["sources"].withColumn("suggested_domain", F.col("id") % 7), scores, 0.6)


@query(f"{given('offers')} SELECT source_id, file_index, CASE WHEN source_id % 3 <> 0 OR coalesce(confidence = 0, false) THEN item_id WHEN file_index % 2 = 0 THEN file_index END AS item_id FROM offers")
def remapped_offers(spark, d):
    offers = base(spark, d, "offers")
    stale = offers.where("source_id % 3 = 0").select(F.col("source_id").alias("id"))
    matches = offers.where("file_index % 2 = 0").select("source_id", "file_index", F.col("file_index").alias("item_id"), F.lit(2).alias("confidence"))
    return lifecycle.remap(offers, stale, matches).select("source_id", "file_index", "item_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END AS track, [CASE WHEN p_partkey % 2 = 0 THEN 'proto' ELSE 'beta' END, 'bios'] AS flags, CASE WHEN p_partkey % 2 = 0 THEN 'ABCD' END AS bytes, CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'ratio' END AS policy, CASE WHEN p_partkey % 4 = 1 THEN p_size + 0.5 END::DOUBLE AS ratio FROM part")
def small_texts(spark, d):
    """Track numbers, status words, spaced digits and policies."""
    rows = table(spark, d, "part").selectExpr(
        "p_partkey", "CASE p_partkey % 3 WHEN 0 THEN concat('d/track ', p_size, '.bin') WHEN 1 THEN concat('d/t', p_size) ELSE 'd/image.chx' END AS path",
        "concat(CASE WHEN p_partkey % 2 = 0 THEN 'Proto' ELSE 'BETA' END, ', BIOS bios good') AS status", "CASE WHEN p_partkey % 2 = 0 THEN 'ab CD' ELSE 'abc' END AS digits",
        "CASE p_partkey % 4 WHEN 0 THEN ' None' WHEN 1 THEN concat('ratio ', p_size, '.5') WHEN 2 THEN 'ratio 0' ELSE 'x' END AS policy",
    )
    return rows.select("p_partkey", text.track_number("path").alias("track"), text.known_words("status", ("beta", "proto", "bios")).alias("flags"), F.hex(text.spaced_hex("digits")).alias("bytes"), text.seed_policy("policy")["policy"].alias("policy"), text.seed_policy("policy")["ratio"].alias("ratio"))
