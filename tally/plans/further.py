"""Named queries of events, scans, JSON and names, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, naming, text
from ..operators import events, groups, relational
from .catalogue import table
from .queries import query
from .reconcile import base, given

_RING = "ring AS (SELECT user_id % 7 AS channel, event_id AS seq, (event_id >= 400)::INT AS epoch FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id DESC) <= 40)"


def _ring(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("channel"), F.col("event_id").alias("seq"), (F.col("event_id") >= 400).cast("int").alias("epoch"), "event_type")
    return events.replayable(e, ["channel"], "seq", 40, F.col("event_type") == "view").select("channel", "seq", "epoch")


@query(f"WITH {_RING} SELECT channel, seq FROM ring")
def replay_ring_without_transient(spark, d):
    return _ring(spark, d).select("channel", "seq")


@query(f"WITH {_RING}, c AS (SELECT s_suppkey AS client, s_suppkey % 8 AS channel, s_suppkey * 60 AS last, s_suppkey % 2 AS seen_epoch FROM supplier), b AS (SELECT channel, min(seq) AS low, max(epoch) AS now FROM ring GROUP BY 1) SELECT c.channel, client, (SELECT count(*) FROM ring r WHERE r.channel = c.channel AND seq > last) AS missed, coalesce(seen_epoch = now AND last + 1 >= low, false) AS complete, (SELECT count(*) FROM ring r WHERE r.channel = c.channel AND seq > last) > 20 AS closed FROM c LEFT JOIN b ON b.channel = c.channel")
def replay_resume(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("client"), (F.col("s_suppkey") % 8).alias("channel"), (F.col("s_suppkey") * 60).alias("last"), (F.col("s_suppkey") % 2).alias("seen_epoch"))
    return events.resumes(_ring(spark, d), s, ["channel"], "seq", "epoch", 20)


@query("WITH e AS (SELECT user_id, event_id * 7 AS t FROM events), m AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 400, true)::INT AS new FROM e), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS burst FROM m) SELECT user_id, max(t) + 400 AS at, count(*) AS n FROM b GROUP BY user_id, burst")
def coalesced_signals(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") * 7).alias("t"))
    return events.coalesced(e, ["user_id"], "t", 400)


@query("WITH p AS (SELECT user_id, event_id, event_type <> 'error' AND event_id % 3 = 0 AS ok FROM events), r AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM p) SELECT user_id, event_id, CASE WHEN sum((NOT ok)::INT) OVER (PARTITION BY user_id, run ORDER BY event_id) >= 3 THEN 60 ELSE 5 END AS wait FROM r")
def poll_cadence(spark, d):
    p = table(spark, d, "events").select("user_id", "event_id", ((F.col("event_type") != "error") & (F.col("event_id") % 3 == 0)).alias("ok"))
    return events.cadence(p, ["user_id"], "event_id", "ok", 5, 60).select("user_id", "event_id", "wait")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 2 = 0)")
def resumed_scan_units(spark, d):
    e = table(spark, d, "events")
    return events.resumed_scan(e.select("user_id").distinct(), e.where("event_type = 'purchase' and event_id % 2 = 0"), "user_id")


@query(f"{given('files')} SELECT id FROM files WHERE id % 9 = 0")
def scan_deletes_at_end(spark, d):
    files = base(spark, d, "files")
    return events.deferred_deletes(files, files.where("id % 9 <> 0"), ["id"], True).select("id")


@query(f"{given('items', 'entries')}, st AS (SELECT domain, count(*) AS n FROM entries GROUP BY 1) SELECT s_suppkey FROM supplier LEFT JOIN st ON st.domain = s_suppkey % 6 WHERE (CASE WHEN s_suppkey % 2 = 0 THEN n ELSE 1 END) IS DISTINCT FROM n")
def stale_stamps(spark, d):
    stamps = groups.stamp(base(spark, d, "entries"), ["domain"], "id").select("domain", "n")
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 6).alias("domain"))
    s = s.join(stamps, "domain", "left").withColumn("stored", F.when(F.col("s_suppkey") % 2 == 0, F.col("n")).otherwise(F.lit(1))).drop("n")
    return events.stale(s, stamps, "domain", "stored", "n").select("s_suppkey")


@query("SELECT (SELECT count(*) FROM part WHERE p_partkey % 10 = 0) AS missing, (SELECT count(*) FROM part WHERE p_partkey % 15 = 1) AS orphaned")
def index_damage(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    index = p.where("p_partkey % 10 <> 0").unionByName(p.where("p_partkey % 15 = 1"))
    return events.index_damage(p, index, ["p_partkey", "p_name"])


@query("SELECT 'schema' AS \"check\", 5::DOUBLE AS value, true AS ok UNION ALL SELECT 'drift', count(*)::DOUBLE, count(*) = 0 FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'paths', count(*)::DOUBLE, count(*) = 0 FROM pages WHERE url IS NULL")
def doctor_report(spark, d):
    count = lambda df: df.agg(F.count("*").alias("value")).withColumn("ok", F.col("value") == 0)
    version = table(spark, d, "region").agg(F.count("*").alias("value")).withColumn("ok", F.col("value") == 5)
    return events.doctor({"schema": version, "drift": count(table(spark, d, "orders").where("o_totalprice < 0")), "paths": count(table(spark, d, "pages").where("url is null"))})


@query("SELECT p_partkey, '{\"p_brand\":' || to_json(p_brand)::VARCHAR || ',\"p_size\":' || p_size || ',\"none\":null}' AS document FROM part")
def json_documents(spark, d):
    return events.json_rows(table(spark, d, "part").withColumn("none", F.lit(None).cast("int")), ["p_brand", "p_size", "none"]).select("p_partkey", "document")


_BROKEN = "CASE event_id % 5 WHEN 0 THEN '{\"k\":' WHEN 1 THEN '{\"other\": 1}' ELSE props END"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'not json' ELSE 'field k' END AS reason FROM events WHERE event_id % 5 IN (0, 1)")
def json_quarantine(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_BROKEN).alias("props"))
    return events.read_json(rows, "props", "k bigint", ["k"])[1].select("event_id", "reason")


@query("SELECT event_id, (props ->> 'k')::BIGINT AS k FROM events WHERE event_id % 5 NOT IN (0, 1)")
def json_fields(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_BROKEN).alias("props"))
    return events.read_json(rows, "props", "k bigint", ["k"])[0].select("event_id", "k")


_CASES = {"click": ["event_id"], "error": ["event_id", "value"]}


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN event_type END AS tag, CASE event_type WHEN 'click' THEN 'code,event_id' WHEN 'error' THEN 'code,event_id,value' END AS fields FROM events")
def tagged_union(spark, d):
    rows = table(spark, d, "events").withColumn("doc", events.tagged(F.col("event_type"), _CASES))
    return rows.select("event_id", events.tag_of("doc", _CASES).alias("tag"), F.array_join(F.json_object_keys("doc"), ",").alias("fields"))


# names, paths, text ----------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name || ' (DB Export)' END AS name, CASE WHEN p_partkey % 3 <> 0 THEN CASE p_partkey % 3 WHEN 1 THEN p_size::VARCHAR ELSE '' END END AS version FROM part")
def export_names(spark, d):
    rows = table(spark, d, "part").withColumn("f", F.expr("concat('in/', p_name, CASE p_partkey % 3 WHEN 1 THEN concat(' (db Export) (', p_size, ').XML') WHEN 2 THEN ' (DB EXPORT).zip' ELSE ' (20240101).dat' END)"))
    return rows.select("p_partkey", text.export_name("f")["name"].alias("name"), text.export_name("f")["version"].alias("version"))


@query("SELECT page_id, strlen(url) AS n, md5(url || '%zz%4') AS md5 FROM pages")
def percent_decoded(spark, d):
    coded = F.concat(text.percent_encode("url"), F.lit("%zz%4"))
    rows = table(spark, d, "pages").withColumn("bytes", text.percent_decode(coded))
    return rows.select("page_id", (F.octet_length("bytes") - 5).cast("long").alias("n"), F.md5("bytes").alias("md5"))


@query("SELECT page_id, url FROM pages WHERE url >= 'https://' AND url < 'https:0' AND url > 'https://m' ORDER BY url, page_id LIMIT 50")
def keyset_under_prefix(spark, d):
    return relational.page(table(spark, d, "pages").where(text.prefix_range("url", "https://") & (F.col("url") > "https://m")).select("page_id", "url"), [F.col("url"), F.col("page_id")], 50)


@query("SELECT c_custkey FROM customer WHERE starts_with(lower(c_name), 'customer#00000001')")
def member_range_nocase(spark, d):
    paths = table(spark, d, "customer").withColumn("path", F.concat(F.substring("c_name", 1, 17), F.lit("/"), F.col("c_name")))
    return paths.where(text.member_range("path", "CUSTOMER#00000001", nocase=True)).select("c_custkey")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS fits FROM part")
def name_fits_rules(spark, d):
    rows = table(spark, d, "part").withColumns({"item": F.concat("p_name", F.lit(".bin")), "path": F.expr("concat('x/', CASE WHEN p_partkey % 4 = 3 THEN 'z' ELSE '' END, p_name, CASE p_partkey % 4 WHEN 1 THEN '.CUE' WHEN 2 THEN '.iso' ELSE '.bin' END)")})
    return rows.select("p_partkey", text.name_fits("path", "item", ("cue", "chd")).alias("fits"))


@query("SELECT p_partkey, [lower(w) FOR w IN string_split(p_name, ' ')] AS words FROM part")
def name_words(spark, d):
    """Names in a written form with versions and tags that say nothing about which title they are."""
    spelt = F.concat(F.translate("p_name", " ", "_"), F.lit("_v"), F.col("p_size"), F.lit("."), F.col("p_size"), F.lit(" rev 2 ("), F.col("p_brand"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", text.words(spelt).alias("words"))


@query("SELECT p_partkey, lower(p_type) AS family FROM part")
def family_keys(spark, d):
    spelt = F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.lit("  (Parent-Clone)")).otherwise(F.lit(" [Retool 2024-01-01]")), F.lit(" (v1."), F.col("p_size"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", text.family_key(spelt).alias("family"))


@query("SELECT p_partkey, p_name AS base_name, ['USA', 'Japan'] AS regions, ['En', 'Fr'] AS languages, 'Rev ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ', Beta 2' ELSE '' END AS revision, [1, p_size, 0, 0]::INT[] AS version, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END AS stage, (CASE WHEN p_partkey % 2 = 0 THEN ['beta'] ELSE [] END || ['other:' || p_brand, 'baddump'])::VARCHAR[] AS flags, (p_partkey % 5 + 1)::INT AS disc FROM part")
def release_name_fields(spark, d):
    """Names composed from the table's columns, taken apart again."""
    name = F.concat(F.col("p_name"), F.lit(" (USA, Japan, USA) (En,Fr) (Rev "), F.col("p_size"), F.lit(")"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" (Beta 2)")).otherwise(F.lit("")), F.lit(" ("), F.col("p_brand"), F.lit(") (Disc "), F.col("p_partkey") % 5 + 1, F.lit(") [b2]"))
    p = table(spark, d, "part").withColumn("f", naming.parsed_name(name))
    return p.select("p_partkey", *[F.col(f"f.{c}").alias(c) for c in ("base_name", "regions", "languages", "revision", "version", "stage", "flags", "disc")])


@query("SELECT p_partkey, replace(lower(p_name), ' ', ' ') || ' ab 3 fi _' AS key FROM part")
def match_keys(spark, d):
    """Full-width letters, ligatures, case, blanks and characters unfit for files."""
    return table(spark, d, "part").select("p_partkey", naming.normalize_for_match(F.concat(F.upper("p_name"), F.lit("  ＡＢ　３ ﬁ :"))).alias("key"))



@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 1 WHEN 'NATION_3' THEN 2 ELSE 4611686018427387904 END AS bit FROM nation")
def known_bits(spark, d):
    return table(spark, d, "nation").select("n_nationkey", hashing.bit_of("n_name", ["NATION_1", "NATION_3"]).alias("bit"))


@query("WITH w AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, n FROM w WHERE n > 5")
def grouped_read(spark, d):
    """Rows of one key together: a sum a key, without a merge of sorted rows."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n")).where("n > 5")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 256 AS chunk, o_orderkey % 50 = 0 AS changed FROM orders")
def rematch_by_chunks(spark, d):
    from ..operators.loads import pieces

    return pieces(table(spark, d, "orders"), ["o_orderkey"], 256, "chunk").select("o_orderkey", "chunk", (F.col("o_orderkey") % 50 == 0).alias("changed"))
