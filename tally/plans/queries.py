"""Named queries on the test tables, each with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import tables
from ..functions import hashing, naming, text
from ..operators import bind, browse, diff, fuzzy, groups, match, pick, quality, relational, state
from ..streaming import streams
from . import catalogue as cat
from .catalogue import ENTRIES_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# groups, picks, browsing -----------------------------------------------------


@query(f"WITH {ENTRIES_SQL} SELECT g.*, n_name FROM full_groups g JOIN nation ON n_nationkey = domain")
def completeness_summary(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("domain"), "n_name")
    return cat.groups(spark, d).join(names, "domain")


@query(f"WITH {ENTRIES_SQL} SELECT * FROM picks")
def pick_per_group(spark, d):
    return pick.pick(cat.entries(spark, d), ["root", "domain"], cat.pick_order()).select("root", "domain", F.col("entry").alias("pick_id"))


@query(f"WITH {ENTRIES_SQL} SELECT root, domain, entry FROM entries WHERE bit & 16 = 0 QUALIFY row_number() OVER (PARTITION BY root, domain ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_totalprice DESC, entry) = 1")
def pick_by_preference(spark, d):
    e = cat.entries(spark, d)
    order = [pick.preference_rank(F.col("o_orderpriority"), ["3-MEDIUM", "2-HIGH"]), F.desc("o_totalprice"), F.col("entry")]
    return pick.pick(e, ["root", "domain"], order, hidden=F.col("bit").bitwiseAND(F.lit(16)) != 0).select("root", "domain", "entry")


@query("SELECT o_custkey, o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus)::BIGINT AS revision_rank FROM orders")
def dense_revision_rank(spark, d):
    ranked = pick.revision_rank(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderstatus")])
    return ranked.select("o_custkey", "o_orderkey", long("revision_rank").alias("revision_rank"))


@query("SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS parent FROM orders")
def infer_groups(spark, d):
    orders = table(spark, d, "orders").withColumn("key", F.concat_ws("/", "o_custkey", "o_orderstatus"))
    return pick.infer_groups(orders, "key", "o_orderkey", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "parent")


@query(f"WITH {ENTRIES_SQL} SELECT domain, n_name, count(*) AS groups, count(*) FILTER (WHERE have > 0) AS have, count(*) FILTER (WHERE wanted > 0) AS wanted FROM groups JOIN nation ON n_nationkey = domain GROUP BY ALL")
def domain_counts(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("domain"), "n_name")
    g = groups.group_summary(cat.entries(spark, d), ["root", "domain"])
    return groups.domain_counts(g, "domain").join(names, "domain")


@query(f"""WITH {ENTRIES_SQL}, flags AS (SELECT root, domain, bool_or(o_orderstatus = 'O' AND NOT complete) AS failing, max(complete::INT) AS have FROM entries GROUP BY ALL)
SELECT domain, count(*) FILTER (WHERE failing AND have = 0) AS failing, count(*) FILTER (WHERE have = 0) AS none FROM flags GROUP BY domain""")
def failing_counts(spark, d):
    e = cat.entries(spark, d).groupBy("root", "domain").agg(F.bool_or((F.col("region_bit") == 2) & ~F.col("complete")).alias("failing"), F.max(F.col("complete").cast("int")).alias("have"))
    return e.groupBy("domain").agg(F.count_if(F.col("failing") & (F.col("have") == 0)).alias("failing"), F.count_if(F.col("have") == 0).alias("none"))


BROWSE = browse.Filter(search="CUSTOMER#0000001", hidden=24, region=1, required=(1,))


_BROWSE_SQL = f"""WITH {ENTRIES_SQL}, shown AS (
  SELECT root, domain, c_name AS name, have, newest_id FROM full_groups g JOIN customer ON c_custkey = root
  WHERE EXISTS (SELECT 1 FROM entries e WHERE e.root = g.root AND e.domain = g.domain AND {{test}}) {{more}}
) SELECT * FROM shown ORDER BY {{order}} LIMIT 50 OFFSET {{offset}}"""


@query(_BROWSE_SQL.format(test="e.bit & 24 = 0 AND e.region_bit & 1 <> 0 AND e.bit & 1 <> 0", more="AND contains(lower(c_name), 'customer#0000001')", order="lower(name), root", offset=0))
def browse_page(spark, d):
    page, _ = browse.browse(cat.browsed(spark, d), cat.entries(spark, d), ["root", "domain"], BROWSE, "name", "root", 50)
    return page.select("root", "domain", "name", "have", "newest_id")


@query(_BROWSE_SQL.format(test="e.bit & 16 = 0", more="", order="have > 0 DESC, lower(name), root", offset=25))
def browse_have_first(spark, d):
    page, _ = browse.browse(cat.browsed(spark, d), cat.entries(spark, d), ["root", "domain"], browse.Filter(hidden=16, sort="have"), "name", "root", 50, 25)
    return page.select("root", "domain", "name", "have", "newest_id")


@query(_BROWSE_SQL.format(test="true", more="AND have > 0", order="newest_id DESC, root", offset=0))
def browse_newest(spark, d):
    page, _ = browse.browse(cat.browsed(spark, d), cat.entries(spark, d), ["root", "domain"], browse.Filter(have=True, sort="newest"), "name", "root", 50)
    return page.select("root", "domain", "name", "have", "newest_id")


@query(f"WITH {ENTRIES_SQL} SELECT count(*) AS total FROM full_groups g WHERE wanted > 0 AND EXISTS (SELECT 1 FROM entries e WHERE e.root = g.root AND e.domain = g.domain AND e.bit & 24 = 0)")
def browse_total(spark, d):
    return browse.browse(cat.browsed(spark, d), cat.entries(spark, d), ["root", "domain"], browse.Filter(hidden=24, wanted=True), "name", "root")[1]


@query("SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'apache license')")
def ascii_search(spark, d):
    return table(spark, d, "documents").where(text.ascii_contains("text", "Apache License")).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')")
def trigram_search(spark, d):
    parts = table(spark, d, "part")
    postings = cat.stored(spark, d, "part-trigrams", lambda: browse.trigram_postings(parts, "p_partkey", "p_name"))
    return browse.trigram_search(parts, postings, "p_partkey", "p_name", "widget").select("p_partkey", "p_name")


@query("SELECT page_id, url FROM pages WHERE url >= 'https://' AND url < 'https:0' ORDER BY url, page_id LIMIT 100")
def prefix_range(spark, d):
    return relational.page(table(spark, d, "pages").where(text.prefix_range("url", "https://")).select("page_id", "url"), [F.col("url"), F.col("page_id")], 100)


@query("SELECT event_id, user_id FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def keyset_page(spark, d):
    return relational.keyset(table(spark, d, "events"), "event_id", 500, 200).select("event_id", "user_id")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 ORDER BY o_orderkey IS NULL, o_orderkey, c_custkey LIMIT 150")
def nulls_last_page(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rows = table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left")
    return relational.page(rows, [*relational.nulls_last("o_orderkey"), F.col("c_custkey")], 150)


@query(f"""WITH {ENTRIES_SQL} SELECT root, domain, string_agg(entry || ':' || bit || ':' || complete, ',' ORDER BY entry) AS members FROM entries GROUP BY root, domain""")
def group_detail(spark, d):
    e = cat.entries(spark, d)
    return groups.detail(e.select("root", "domain").distinct(), e, ["root", "domain"], ["bit", "complete"], "entry").select(
        "root", "domain", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["entry"], m["bit"], m["complete"])), ",").alias("members")
    )


# joins -----------------------------------------------------------------------


_DIGESTS = "SELECT doc_id, sha1(text) AS sha1, md5(text) AS md5, length(text)::BIGINT AS size, left(md5(text), 8) AS head FROM documents"
_TIERS_SQL = f"""WITH hashed AS ({_DIGESTS}), catalogue AS (
  SELECT doc_id AS item_id, CASE WHEN doc_id % 6 = 0 THEN sha1 END AS sha1, CASE WHEN doc_id % 6 IN (0, 2) THEN md5 END AS md5, head AS crc32, size FROM hashed WHERE doc_id % 2 = 0
), files AS (SELECT doc_id AS file_id, sha1, md5, size, head AS crc32 FROM hashed WHERE doc_id % 2 = 1), hits AS (
  SELECT file_id, item_id, 1 AS tier FROM files f JOIN catalogue c ON f.sha1 = c.sha1
  UNION ALL SELECT file_id, item_id, 2 FROM files f JOIN catalogue c ON f.md5 = c.md5 AND c.sha1 IS NULL
  UNION ALL SELECT file_id, item_id, 3 FROM files f JOIN catalogue c ON f.crc32 = c.crc32 AND f.size = c.size AND c.sha1 IS NULL AND c.md5 IS NULL)"""


def _tier_hits(spark, d):
    hashed = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.md5("text").alias("md5"), long(F.length("text")).alias("size"), F.substring(F.md5("text"), 1, 8).alias("crc32"))
    side = hashed.where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 6 == 0, F.col("sha1")).alias("sha1"), F.when((F.col("doc_id") % 6).isin(0, 2), F.col("md5")).alias("md5"), "crc32", "size")
    files = hashed.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "file_id")
    return match.tier_matches(files, side)


@query(f"{_TIERS_SQL} SELECT file_id, item_id, tier::INT AS tier FROM hits QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY tier, item_id) = 1")
def tiered_hash_match(spark, d):
    return match.best_match(_tier_hits(spark, d), order=[F.col("item_id")]).select("file_id", "item_id", "tier")


@query(f"{_TIERS_SQL} SELECT file_id, item_id, tier::INT AS tier FROM hits QUALIFY tier = min(tier) OVER (PARTITION BY file_id)")
def match_candidates_all_ties(spark, d):
    return match.first_tier_matches(_tier_hits(spark, d)).select("file_id", "item_id", "tier")


@query(f"""WITH hashed AS ({_DIGESTS}), forms AS (
  SELECT doc_id AS file_id, 0 AS form, sha1 FROM hashed WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 1, sha1(substr(text, 5)) FROM documents WHERE doc_id % 2 = 1
), catalogue AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 4 = 0 THEN sha1(substr(text, 5)) ELSE sha1(text) END AS sha1, doc_id % 3 = 0 AS live FROM documents WHERE doc_id % 2 = 0)
SELECT file_id, item_id, form::INT AS form, live FROM forms JOIN catalogue USING (sha1) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY live DESC, form, item_id) = 1""")
def two_form_match(spark, d):
    docs = table(spark, d, "documents")
    rest = F.substring(F.col("text"), F.lit(5), F.length("text"))
    odd = docs.where("doc_id % 2 = 1")
    forms = odd.select(F.col("doc_id").alias("file_id"), F.explode(F.array(F.struct(F.lit(0).alias("form"), F.sha1("text").alias("sha1")), F.struct(F.lit(1).alias("form"), F.sha1(rest).alias("sha1")))).alias("x")).select("file_id", "x.form", "x.sha1")
    side = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 4 == 0, F.sha1(rest)).otherwise(F.sha1("text")).alias("sha1"), (F.col("doc_id") % 3 == 0).alias("live"))
    return match.form_matches(forms, side, tiers=((("sha1",), ()),), order=[F.col("item_id")]).select("file_id", "item_id", "form", "live")


@query("SELECT doc_id FROM documents d WHERE doc_id % 2 = 1 AND EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 2 = 0 AND c.n_chars = d.n_chars AND md5(c.text) = md5(d.text))")
def candidate_precheck(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("md5"))
    return match.possible(docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0"), ["n_chars", "md5"]).select("doc_id")


@query("""WITH best AS (SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_extendedprice DESC, l_partkey, l_suppkey) = 1)
SELECT o_orderkey, l_partkey, l_extendedprice FROM orders LEFT JOIN best ON l_orderkey = o_orderkey""")
def best_row_left_join(spark, d):
    flag = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    joined = relational.left_join_best(table(spark, d, "orders"), items, ["o_orderkey"], [flag, F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey")])
    return joined.select("o_orderkey", "l_partkey", "l_extendedprice")


@query("SELECT c_custkey, o_orderkey AS latest FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def latest_row_left_join(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return relational.left_join_latest(table(spark, d, "customer"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", F.col("o_orderkey").alias("latest"))


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > 300000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
def semi_exists_or(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity = 50").withColumnRenamed("l_orderkey", "o_orderkey")
    return relational.exists_flag(table(spark, d, "orders"), big, ["o_orderkey"], "full").where((F.col("o_totalprice") > 300000) | F.col("full")).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti_missing(spark, d):
    partly = table(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return relational.missing_from(table(spark, d, "customer"), partly, ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def null_aware_not_in(spark, d):
    return relational.not_in(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_totalprice > 200000"), "c_custkey", "o_custkey")


@query("""WITH offers AS (SELECT p_partkey AS offer, p_name AS name, substr(p_type, 1, 5) AS base, p_size AS size FROM part WHERE p_partkey % 2 = 0),
items AS (SELECT min(p_partkey) AS item, p_name AS name, substr(p_type, 1, 5) AS base, p_size AS size, p_brand AS domain FROM part WHERE p_partkey % 2 = 1 GROUP BY ALL),
named AS (SELECT offer, item, domain FROM offers JOIN items USING (name, size)), based AS (SELECT offer, item, domain FROM offers JOIN items USING (base, size))
SELECT *, 'name' AS "by" FROM named UNION ALL SELECT *, 'base' FROM based b WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.offer = b.offer AND n.domain = b.domain)""")
def name_then_base_fallback(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.substring("p_type", 1, 5).alias("base"), F.col("p_size").alias("size"), F.col("p_brand").alias("domain"))
    offers = part.where("p_partkey % 2 = 0").drop("domain").withColumnRenamed("p_partkey", "offer")
    items = part.where("p_partkey % 2 = 1").groupBy("name", "base", "size", "domain").agg(F.min("p_partkey").alias("item"))
    return match.name_then_base(offers, items, ["name", "size"], ["base", "size"], "domain", "offer", "item")


@query("""SELECT l_partkey AS item, l_suppkey AS source, 0::INT AS confidence, sum(l_quantity)::BIGINT AS held FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
UNION ALL SELECT l_partkey, l_suppkey, 3, sum(l_quantity)::BIGINT FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL""")
def availability_union(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("source"), "l_returnflag", "l_quantity")
    side = lambda flag, c: rows.where(F.col("l_returnflag") == flag).groupBy("item", "source").agg(long(F.sum("l_quantity")).alias("held")).withColumn("confidence", F.lit(c))
    return match.available(side("R", 0), side("A", 3), "item").select("item", "source", "confidence", "held")


@query("""WITH load AS (SELECT l_suppkey, count(*) AS load FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1), ruled AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A')
SELECT l_partkey AS item, l_suppkey AS source, l_quantity::BIGINT AS size, coalesce(load, 0) AS load FROM lineitem LEFT JOIN load USING (l_suppkey)
WHERE NOT EXISTS (SELECT 1 FROM ruled r WHERE r.l_partkey = lineitem.l_partkey AND r.l_suppkey = lineitem.l_suppkey)
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, coalesce(load, 0), l_suppkey, l_orderkey, l_linenumber) = 1""")
def best_offer_per_item(spark, d):
    rows = table(spark, d, "lineitem")
    loaded = match.with_load(rows, rows.where("l_linestatus = 'O'"), "l_suppkey")
    order = [F.desc("l_quantity"), F.col("load"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")]
    best = match.best_offer(loaded, "l_partkey", order, rows.where("l_returnflag = 'A'"), ["l_partkey", "l_suppkey"])
    return best.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("source"), long("l_quantity").alias("size"), "load")


@query("""WITH w AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY 1) AS k FROM lineitem WHERE l_returnflag <> 'A'),
h AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY 1) AS k FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey, count(*) FILTER (WHERE w.k IS NOT NULL AND h.k IS NOT NULL) AS pairs, count(*) FILTER (WHERE h.k IS NULL) AS absent, count(*) FILTER (WHERE w.k IS NULL) AS extra,
 count(*) FILTER (WHERE h.k IS NULL) = 0 AND count(*) FILTER (WHERE w.k IS NULL) = 0 AS exact
FROM w FULL JOIN h USING (l_orderkey, l_partkey, k) GROUP BY l_orderkey""")
def members_exact(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    return match.members_exact(rows.where("l_returnflag <> 'A'"), rows.where("l_linestatus = 'F'"), ["l_orderkey"], ["l_partkey"])


@query("""WITH a AS (SELECT DISTINCT o_custkey AS root, translate(o_orderpriority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM orders), b AS (SELECT DISTINCT o_custkey AS other, lower(o_orderpriority) AS key FROM orders WHERE o_orderstatus = 'F')
SELECT root, other, key FROM a JOIN b USING (key) WHERE root = other""")
def nocase_join(spark, d):
    orders = table(spark, d, "orders")
    a = orders.select(F.col("o_custkey").alias("root"), text.ascii_lower("o_orderpriority").alias("key")).distinct()
    b = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("other"), text.ascii_lower("o_orderpriority").alias("key")).distinct()
    return a.join(b, (a["key"] == b["key"]) & (F.col("root") == F.col("other"))).select("root", "other", a["key"])


@query("""WITH words AS (SELECT p_partkey, p_size, string_split(p_name, ' ') AS w, p_brand FROM part), f AS (SELECT * FROM words WHERE p_partkey % 2 = 0), i AS (SELECT * FROM words WHERE p_partkey % 2 = 1),
pairs AS (SELECT f.p_partkey AS file_id, i.p_partkey AS item, i.p_brand AS i_group, CASE WHEN f.w = i.w THEN 3 WHEN array_to_string(f.w, '') = array_to_string(i.w, '') THEN 2
  WHEN len(i.w) > len(f.w) AND i.w[1:len(f.w)] = f.w AND NOT regexp_full_match(i.w[len(f.w) + 1], '[0-9]+') AND i.w[len(f.w) + 1] NOT IN ('ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x') THEN 1 END AS signal
  FROM f JOIN i ON f.p_size = i.p_size AND substr(f.w[1], 1, 1) = substr(i.w[1], 1, 1))
SELECT file_id, item, signal::INT AS signal FROM (SELECT *, len(list_distinct(list(i_group) OVER (PARTITION BY file_id))) AS g FROM pairs WHERE signal IS NOT NULL) WHERE g <= 4""")
def fuzzy_size_bucket(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), text.words(F.concat("p_name", F.lit(" v1.2 (x)"))).alias("words"), F.col("p_brand").alias("group_id"))
    files, items = rows.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("file_id"), "size", "words"), rows.where("p_partkey % 2 = 1")
    return fuzzy.fuzzy_join(files, items).select("file_id", F.col("i_p_partkey").alias("item"), "signal")


# binding ---------------------------------------------------------------------


_HITS_SQL = """WITH m AS (SELECT DISTINCT l_suppkey AS source, c_nationkey AS domain, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 40),
hits AS (SELECT source, domain, count(*) AS hits FROM (SELECT DISTINCT source, domain, l_partkey FROM m) GROUP BY ALL), totals AS (SELECT l_suppkey AS source, count(DISTINCT l_partkey) AS total FROM lineitem GROUP BY 1),
scored AS (SELECT source, domain, hits, total, hits / total AS score, row_number() OVER (PARTITION BY source ORDER BY hits / total DESC, domain) AS rank FROM hits JOIN totals USING (source))"""


def _bind_matches(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    nations = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("domain"))
    rows = table(spark, d, "lineitem").where("l_quantity > 40").join(orders, "l_orderkey").join(nations, "o_custkey")
    return rows.select(F.col("l_suppkey").alias("source"), "domain", "l_partkey", "l_quantity", F.when(F.col("l_returnflag") == "R", 1).otherwise(2).alias("tier"))


def _scored(spark, d):
    hits = bind.domain_hits(_bind_matches(spark, d), "source", "domain", ["l_partkey"])
    totals = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count_distinct("l_partkey").alias("total"))
    return bind.scores(hits, totals, "source", "domain")


@query(f"{_HITS_SQL} SELECT source, domain, hits, total, score, rank::INT AS rank FROM scored")
def bind_scores(spark, d):
    return _scored(spark, d).select("source", "domain", "hits", "total", "score", "rank")


@query(f"{_HITS_SQL} SELECT source, CASE WHEN score >= 0.02 THEN domain END AS bound, score FROM scored WHERE rank = 1")
def bind_winner(spark, d):
    return bind.bind(_scored(spark, d), "source", "domain", 0.02)


@query(f"""{_HITS_SQL}, b AS (SELECT source, domain FROM scored WHERE rank = 1 AND score >= 0.02), t AS (SELECT DISTINCT l_suppkey AS source, c_nationkey AS domain, l_partkey, l_quantity, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 2 END AS tier FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 40)
SELECT source, domain, l_partkey, l_quantity, tier::INT AS tier, row_number() OVER (PARTITION BY source, l_partkey ORDER BY tier, l_quantity) > 1 AS extra FROM t JOIN b USING (source, domain) QUALIFY tier = min(tier) OVER (PARTITION BY source, l_partkey)""")
def bind_map(spark, d):
    bound = bind.bind(_scored(spark, d), "source", "domain", 0.02)
    rows = bind.bind_and_map(_bind_matches(spark, d).distinct(), bound, "source", "domain", "l_partkey", [F.col("l_quantity")])
    return rows.select("source", "domain", "l_partkey", "l_quantity", "tier", "extra")


@query("""WITH n AS (SELECT count(*) AS total FROM lineitem), s AS (SELECT l_suppkey, l_quantity FROM lineitem, n WHERE l_orderkey % CAST(ceil(total / 5000.0) AS BIGINT) = 0), k AS (SELECT count(*) AS sampled FROM s)
SELECT l_suppkey AS source, count(*) AS hit, least(count(*) * any_value(total) // any_value(sampled), any_value(total))::BIGINT AS estimate FROM s, n, k WHERE l_quantity > 25 GROUP BY 1""")
def preview_extrapolation(spark, d):
    rows = table(spark, d, "lineitem")
    total = rows.count()
    sample = relational.systematic_sample(rows, "l_orderkey", 5000, total)
    sampled = sample.agg(F.count("*").alias("sampled"))
    hits = sample.where("l_quantity > 25").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("hit")).crossJoin(sampled)  # one row
    return hits.select("source", "hit", relational.extrapolate(F.col("hit"), F.col("sampled"), F.lit(total)).alias("estimate"))


@query("""WITH p AS (SELECT page_id, string_split(url, '/') AS parts, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages), t AS (SELECT host, count(*) AS n FROM p GROUP BY 1),
dirs AS (SELECT host, page_id, unnest(list_distinct(parts[1:len(parts) - 1])) AS dir FROM p) SELECT host, dir, count(*) AS files FROM dirs JOIN t USING (host) WHERE dir <> '' GROUP BY host, dir, n HAVING 2 * count(*) >= n""")
def majority_directories(spark, d):
    pages = table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "^https?://([^/]+)", 1))
    return bind.majority_directories(pages, "host", "url").select("host", "dir", "files")


# aggregates, signatures, groups ---------------------------------------------


@query("""WITH s AS (SELECT l_orderkey, md5(string_agg(k, chr(31) ORDER BY k)) AS signature, count(*) AS n FROM (SELECT l_orderkey, l_returnflag || l_linestatus || (l_quantity::INT // 10)::VARCHAR AS k FROM lineitem) GROUP BY 1)
SELECT min(n) AS n, count(*) AS entries, min(l_orderkey) AS first FROM s GROUP BY signature HAVING count(*) > 1""")
def entry_signature_groups(spark, d):
    key = F.concat("l_returnflag", "l_linestatus", F.floor(F.col("l_quantity").cast("int") / 10).cast("string"))
    signed = groups.signature(table(spark, d, "lineitem"), ["l_orderkey"], key)
    return signed.groupBy("signature").agg(F.min("n").alias("n"), F.count("*").alias("entries"), F.min("l_orderkey").alias("first")).where("entries > 1").drop("signature")


@query("""WITH s AS (SELECT l_orderkey, md5(string_agg(k, chr(31) ORDER BY k)) AS signature FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS k FROM lineitem) GROUP BY 1),
e AS (SELECT o_orderkey, o_orderstatus FROM orders), z AS (SELECT o_orderstatus, count(*) AS size FROM e GROUP BY 1), r AS (SELECT e.*, signature, size, size = (SELECT max(size) FROM z) AS big FROM e JOIN s ON l_orderkey = o_orderkey JOIN z USING (o_orderstatus))
SELECT o_orderkey, o_orderstatus, first_value(o_orderkey) OVER (PARTITION BY signature ORDER BY big DESC, o_orderstatus, o_orderkey) AS anchor FROM r QUALIFY o_orderkey <> anchor""")
def link_shared_entries(spark, d):
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    signed = groups.signature(items, ["o_orderkey"], F.concat("l_returnflag", "l_linestatus")).drop("n")
    return groups.link_shared(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), signed, "o_orderkey", "o_orderstatus")


@query("""WITH n AS (SELECT o_orderkey AS node, (o_custkey % 97 + o_orderkey // 64 * 64) AS target, o_orderstatus <> 'P' AS live FROM orders),
r AS (SELECT target, CASE WHEN bool_or(node = target) THEN target ELSE coalesce(min(node) FILTER (WHERE live), min(node)) END AS root FROM n GROUP BY target) SELECT node, target, root FROM n JOIN r USING (target)""")
def reroot_groups(spark, d):
    target = F.col("o_custkey") % 97 + F.floor(F.col("o_orderkey") / 64) * 64
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), target.alias("target"), (F.col("o_orderstatus") != "P").alias("live"))
    return groups.reroot(nodes, "node", "target", F.col("live")).select("node", "target", "root")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS other FROM events GROUP BY 1")
def state_histogram(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other")
    wide = table(spark, d, "events").withColumn("kind", kind).groupBy("user_id").pivot("kind", ["click", "view", "other"]).count()
    return wide.na.fill(0)


@query("""SELECT s_nationkey, l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, sum(l_quantity)::BIGINT AS size, sum(trunc(l_discount * l_quantity)::BIGINT)::BIGINT AS done FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def version_contribution(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rows = table(spark, d, "lineitem").join(names, "l_suppkey")
    return rows.groupBy("s_nationkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), long(F.sum("l_quantity")).alias("size"), F.sum(long(F.col("l_discount") * F.col("l_quantity"))).alias("done"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def distinct_listing(spark, d):
    return groups.listing(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS o_orderstatus FROM orders GROUP BY 1")
def sole_value(spark, d):
    return groups.shared_value(table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(long(F.sum("l_quantity")).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, o_orderstatus, count(*) AS n, grouping(n_name, o_orderstatus)::BIGINT AS level FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)")
def rollup_counts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = table(spark, d, "orders").join(c, "o_custkey").join(table(spark, d, "nation"), "n_nationkey")
    return rows.rollup("n_name", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT n_regionkey AS domain, count(*) AS n, bit_xor(o_orderkey) AS x, sum(o_orderkey)::BIGINT AS s FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def content_stamp(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    rows = table(spark, d, "orders").join(c, "o_custkey").join(table(spark, d, "nation"), "n_nationkey")
    # the digest of sums, with the key itself in the place of its hash
    return groups.stamp(rows.withColumnRenamed("n_regionkey", "domain"), ["domain"], "o_orderkey", hashed=lambda *c: F.col(c[0]))


@query("SELECT p_size, count(*) OVER (PARTITION BY p_size, p_brand) = 1 AS only, p_partkey FROM part")
def unique_in_source(spark, d):
    rows = table(spark, d, "part").withColumn("words", F.col("p_brand"))
    return fuzzy.unique_words(rows, "p_size").select("p_size", F.col("unique").alias("only"), "p_partkey")


# snapshots -------------------------------------------------------------------


_SNAPS = "a AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 5)"


def _snapshots(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    moved = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "F").otherwise(F.col("o_orderstatus")))
    return orders.where("o_orderkey % 10 <> 3"), moved.where("o_orderkey % 10 <> 5")


@query(f"""WITH {_SNAPS} SELECT o_orderkey, a.o_orderstatus AS old_o_orderstatus, b.o_orderstatus AS new_o_orderstatus, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def snapshot_diff(spark, d):
    a, b = _snapshots(spark, d)
    return diff.snapshot_diff(a, b, ["o_orderkey"], ["o_orderstatus"])


@query(f"WITH {_SNAPS} SELECT o_orderkey, coalesce(b.o_custkey, a.o_custkey) AS o_custkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice FROM a FULL JOIN b USING (o_orderkey)")
def upsert_merge(spark, d):
    a, b = _snapshots(spark, d)
    return diff.upsert(a, b, ["o_orderkey"])


@query(f"WITH {_SNAPS}, k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS id FROM a), n AS (SELECT o_orderkey, (SELECT max(id) FROM k) + row_number() OVER (ORDER BY o_orderkey) AS id FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)) SELECT * FROM k UNION ALL SELECT * FROM n")
def upsert_with_ids(spark, d):
    a, b = _snapshots(spark, d)
    base = diff.numbered(a.select("o_orderkey"), ["o_orderkey"], "id")
    return diff.upsert(base, b.select("o_orderkey"), ["o_orderkey"], "id")


@query(f"WITH {_SNAPS} SELECT b.* FROM b LEFT JOIN a USING (o_orderkey) WHERE a.o_custkey IS NULL OR a.o_orderstatus <> b.o_orderstatus")
def upsert_changed_only(spark, d):
    a, b = _snapshots(spark, d)
    return diff.upsert_changed(a, b, ["o_orderkey"], ["o_orderstatus"])


@query(f"WITH {_SNAPS} SELECT o_orderkey, o_orderkey NOT IN (SELECT o_orderkey FROM b) AS retired FROM a")
def mark_and_sweep(spark, d):
    a, b = _snapshots(spark, d)
    return diff.mark_and_sweep(a, b, ["o_orderkey"]).select("o_orderkey", "retired")


@query("SELECT page_id, url FROM pages WHERE page_id % 3 <> 0 OR starts_with(url, 'https://a')")
def delete_missing(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return diff.delete_missing(pages, pages.where("page_id % 3 <> 0"), ["page_id"], "url", ["https://a"])


@query(f"WITH {ENTRIES_SQL} SELECT root, domain, variants, have, wanted, newest_id, lean_flags, flag_union, region_union FROM groups")
def incremental_refresh_equals_full(spark, d):
    """A summary of old inputs, refreshed for the groups whose entries changed, is the full summary."""
    columns = ["root", "domain", "variants", "have", "wanted", "newest_id", "lean_flags", "flag_union", "region_union"]
    now = cat.entries(spark, d)
    before = now.where(F.col("entry") % 11 != 0).withColumn("wanted", F.when(F.col("entry") % 13 == 0, ~F.col("wanted")).otherwise(F.col("wanted")))
    keys = ["root", "domain"]
    stored = groups.group_summary(before, keys).select(columns)
    dirty = now.where((F.col("entry") % 11 == 0) | (F.col("entry") % 13 == 0)).select(*keys)
    return groups.refresh(stored, dirty, keys, lambda k: groups.group_summary(now.join(k, keys, "left_semi"), keys))


@query(f"WITH {_SNAPS}, aa AS (SELECT o_orderkey, o_orderstatus FROM a), bb AS (SELECT o_orderkey, o_orderstatus FROM b) SELECT (SELECT count(*) FROM (FROM aa EXCEPT FROM bb)) AS stale, (SELECT count(*) FROM (FROM bb EXCEPT FROM aa)) AS missing")
def drift_except(spark, d):
    a, b = _snapshots(spark, d)
    return groups.drift(a.select("o_orderkey", "o_orderstatus"), b.select("o_orderkey", "o_orderstatus"))


@query("""WITH v AS (SELECT p_partkey, regexp_replace(p_type, ' [^ ]*$', '') AS family, p_brand AS version, regexp_extract_all(p_brand, '[0-9]+')::BIGINT[] AS ord FROM part),
w AS (SELECT *, first_value(p_partkey) OVER (PARTITION BY family ORDER BY ord DESC, p_partkey DESC) AS newest FROM v) SELECT p_partkey, family, CASE WHEN newest <> p_partkey THEN newest END AS superseded_by FROM w""")
def family_supersession(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.regexp_replace("p_type", " [^ ]*$", "").alias("family"), text.version_order("p_brand").alias("ord"))
    return diff.supersede(rows, ["family"], ["ord", "p_partkey"], "p_partkey").select("p_partkey", "family", "superseded_by")


@query("SELECT p_type, row_number() OVER (ORDER BY known DESC, p_type) AS id FROM (SELECT p_type, bool_or(p_partkey <= 100) AS known FROM part GROUP BY 1)")
def intern_values(spark, d):
    part = table(spark, d, "part")
    known = diff.numbered(part.where("p_partkey <= 100").select("p_type").distinct(), ["p_type"], "id")
    return diff.intern(part, known, "p_type", "id")


@query("""WITH l AS (SELECT page_id, length(html) AS stamp, md5(html) AS ck FROM pages WHERE page_id % 5 <> 0), s AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 0 ELSE length(html) END AS stamp, CASE WHEN page_id % 7 = 0 THEN '' ELSE md5(html) END AS ck FROM pages WHERE page_id % 4 <> 0)
SELECT page_id, CASE WHEN s.ck IS NULL THEN 'record' WHEN l.ck IS NULL THEN 'drop' WHEN l.ck <> s.ck THEN 'reverify' WHEN l.stamp <> s.stamp THEN 'restamp' END AS action FROM l FULL JOIN s USING (page_id) WHERE l.ck IS DISTINCT FROM s.ck OR l.stamp IS DISTINCT FROM s.stamp""")
def presence_pass(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.length("html").alias("stamp"), F.md5("html").alias("ck"))
    stored = pages.where("page_id % 4 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, 0).otherwise(F.col("stamp")).alias("stamp"), F.when(F.col("page_id") % 7 == 0, "").otherwise(F.col("ck")).alias("ck"))
    return diff.presence(pages.where("page_id % 5 <> 0"), stored, ["page_id"], "stamp", "ck")


# state and events ------------------------------------------------------------


@query("""WITH e AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fresh FROM events), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run, event_type""")
def run_folding(spark, d):
    runs = state.fold_runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return runs.select("user_id", "run", "event_type", "n", F.col("first.event_id").alias("first_id"))


MOVES = {("idle", "view"): "browsing", ("browsing", "click"): "engaged", ("engaged", "purchase"): "bought", ("bought", "view"): "browsing", ("browsing", "purchase"): "bought", ("engaged", "view"): "browsing"}
_STATES_SQL = " ".join(f"WHEN acc.state = '{a}' AND x.state = '{e}' THEN '{b}'" for (a, e), b in MOVES.items())
_COUNTS_SQL = " ".join(f"WHEN acc.state = '{a}' AND x.state = '{e}' THEN 1" for a, e in MOVES)


@query(f"""WITH l AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS ev FROM events GROUP BY 1), f AS (SELECT user_id, ev, list_reduce(list_transform(ev, lambda x: struct_pack(state := x, moves := 0::BIGINT)), lambda acc, x:
 struct_pack(state := CASE {_STATES_SQL} ELSE acc.state END, moves := acc.moves + CASE {_COUNTS_SQL} ELSE 0 END), struct_pack(state := 'idle', moves := 0::BIGINT)) AS s FROM l)
SELECT user_id, s.state AS state, s.moves::BIGINT AS moves, len(ev)::BIGINT AS events FROM f""")
def state_machine_fold(spark, d):
    return state.fold_events(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", "idle", MOVES)


@query("""WITH l AS (SELECT user_id, list(struct_pack(p := event_type, t := epoch(ts), at := epoch(ts), kept := 0::BIGINT) ORDER BY ts, event_id) AS ev FROM events GROUP BY 1),
f AS (SELECT user_id, ev, list_reduce(ev, lambda acc, x: CASE WHEN acc.p IS NULL OR acc.p <> x.p OR x.t - acc.at >= 3600 THEN struct_pack(p := x.p, t := x.t, at := x.t, kept := acc.kept + 1) ELSE acc END, struct_pack(p := NULL::VARCHAR, t := 0::DOUBLE, at := 0::DOUBLE, kept := 0::BIGINT)) AS s FROM l)
SELECT user_id, s.kept AS kept, len(ev)::BIGINT AS events FROM f""")
def throttle_per_phase(spark, d):
    rows = table(spark, d, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    return state.throttle(rows, ["user_id"], ["ts", "event_id"], "event_type", "seconds", 3600.0)


@query("""WITH p AS (SELECT user_id AS path, event_id AS poll, (event_id // 40 % 3) AS size, event_id % 7 AS age FROM events), m AS (SELECT *, coalesce(size = lag(size) OVER w AND age >= 2, false) AS steady FROM p WINDOW w AS (PARTITION BY path ORDER BY poll))
SELECT path, poll, size, age FROM m QUALIFY steady AND NOT lag(steady, 1, false) OVER (PARTITION BY path ORDER BY poll)""")
def stable_files(spark, d):
    polls = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_id").alias("poll"), (F.floor(F.col("event_id") / 40) % 3).alias("size"), (F.col("event_id") % 7).alias("age"))
    return state.stable_files(polls, "path", "poll", "size", "age")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20 OR ts >= TIMESTAMP '2024-01-20'")
def retention_prune(spark, d):
    kept = state.prune(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], 20, F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    return kept.select("event_id", "user_id")


@query("""WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 4 HOUR AS gap FROM events), s AS (SELECT *, sum(coalesce(gap, true)::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM e)
SELECT user_id, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS first FROM s GROUP BY user_id, k""")
def session_runs(spark, d):
    runs = state.session_runs(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", "4 hours")
    return runs.select("user_id", "n", F.unix_timestamp("start").alias("first"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def one_per_subject(spark, d):
    return state.one_per_subject(table(spark, d, "events"), "user_id", "event_type", [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000) THEN 'queued' ELSE 'wanted' END AS state FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def wanted_without_offer(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return state.wanted_without_offer(table(spark, d, "customer").select("c_custkey"), orders.where("o_orderstatus = 'P'"), orders.where("o_totalprice > 350000"), "c_custkey")


# JSON, text, hashes, rules ---------------------------------------------------


@query("SELECT event_id, (props ->> 'k')::BIGINT AS k FROM events WHERE (props ->> 'k')::BIGINT IN (1, 5, 69)")
def json_key_join(spark, d):
    keys = spark.createDataFrame([("[1, 5, 69]",)], "keys string").select(F.posexplode(F.from_json("keys", "array<bigint>")).alias("at", "k"))
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.join(keys, "k").select("event_id", "k")


@query("SELECT event_id, 'k' || chr(31) || (props ->> 'k') AS subject FROM events")
def json_subject(spark, d):
    return table(spark, d, "events").select("event_id", text.subject_key("props").alias("subject"))


@query("SELECT page_id, regexp_extract(url, '[^/\\\\]*$') AS leaf, lower(regexp_extract(regexp_extract(url, '[^/\\\\]*$'), '^.+\\.([^.]+)$', 1)) AS extension FROM pages")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", text.leaf("url").alias("leaf"), text.extension("url").alias("extension"))


@query("SELECT p_partkey, regexp_extract_all(p_brand, '[0-9]+')::BIGINT[] AS version, rtrim(split_part(p_name, '(', 1)) AS base, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS bound FROM part")
def name_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", text.version_order("p_brand").alias("version"), text.base_name("p_name").alias("base"), text.binding_name("p_name").alias("bound"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, strlen(text)::BIGINT AS size FROM documents")
def content_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", *hashing.digests(F.col("text").cast("binary"))[1:])


@query("""SELECT 'orders' AS "table", 'price' AS rule, count(*) AS rows, count(*) FILTER (WHERE NOT o_totalprice > 1000) AS broken FROM orders
UNION ALL SELECT 'orders', 'status', count(*), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'lineitem', 'unique(l_orderkey,l_linenumber)', count(*), count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem
UNION ALL SELECT 'lineitem', 'l_orderkey in o_orderkey', count(*), count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) FROM lineitem""")
def constraint_report(spark, d):
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    rules = {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")}
    out = quality.check_report(orders, "orders", rules)
    return out.unionByName(quality.key_report(items, "lineitem", ["l_orderkey", "l_linenumber"])).unionByName(quality.reference_report(items, "lineitem", "l_orderkey", orders, "o_orderkey"))


@query(f"WITH {ENTRIES_SQL} SELECT root, domain, count(*) FILTER (WHERE wanted) AS picks FROM entries GROUP BY ALL HAVING count(*) FILTER (WHERE wanted) > 1")
def contradicting_picks(spark, d):
    return quality.single_pick(cat.entries(spark, d), ["root", "domain"], "wanted")


@query("""WITH names AS (SELECT DISTINCT lower(p_name) AS name FROM part), patterns(domain, pattern, place) AS (VALUES ('colour', 'red', 0), ('thing', 'red widget', 1), ('thing', 'ring', 2), ('heat', 'hot', 3), ('size', 'small', 4))
SELECT name, domain FROM names JOIN patterns ON contains(' ' || name || ' ', ' ' || pattern || ' ') QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(pattern) DESC, place) = 1""")
def longest_pattern(spark, d):
    names = table(spark, d, "part").select(text.ascii_lower("p_name").alias("name")).distinct()
    patterns = spark.createDataFrame([("colour", "red", 0), ("thing", "red widget", 1), ("thing", "ring", 2), ("heat", "hot", 3), ("size", "small", 4)], "domain string, pattern string, place int")
    return bind.longest_pattern(names, "name", patterns, "domain", "pattern")


@query("SELECT doc_id, trim(regexp_replace(translate(lower(nfc_normalize(text)), '&*/:`<>?\\|\"', '___________'), '\\s+', ' ', 'g')) AS name FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", naming.normalize_for_match("text").alias("name"))


@query("SELECT doc_id, text FROM documents ORDER BY translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), doc_id LIMIT 100")
def ascii_nocase_text_sort(spark, d):
    return relational.page(table(spark, d, "documents").select("doc_id", "text"), [text.ascii_lower("text"), F.col("doc_id")], 100)


@query("SELECT \"group\", p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['USA'] WHEN 1 THEN ['Japan', 'Europe'] ELSE ['Korea'] END AS regions, [1, p_size % 9, 0, 0]::INT[] AS version FROM (SELECT *, lower(p_name) AS \"group\" FROM part) QUALIFY row_number() OVER (PARTITION BY \"group\" ORDER BY CASE p_partkey % 3 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END, p_size % 9 DESC, p_partkey) = 1")
def release_names(spark, d):
    """Names of parts as release names with made-up tags, parsed and picked by region."""
    name = F.concat("p_name", F.lit(" ("), F.element_at(F.array(F.lit("USA"), F.lit("Japan, Europe"), F.lit("Korea")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit(") (Rev "), (F.col("p_size") % 9).cast("string"), F.lit(")"))
    parsed = table(spark, d, "part").select("p_partkey", naming.parsed_name(name).alias("n")).select("p_partkey", "n.*").withColumn("group", F.lower("base_name"))
    order = [pick.list_rank(F.col("regions"), ["Europe", "USA"]), F.desc("version"), F.desc("stage"), F.col("p_partkey")]
    return pick.pick(parsed, ["group"], order, hidden=F.arrays_overlap("flags", F.array(*map(F.lit, naming.HIDDEN_FLAGS)))).select("group", "p_partkey", "regions", "version")


@query("SELECT name FROM (SELECT lower(p_name) AS name FROM part) GROUP BY 1")
def interned_names(spark, d):
    return table(spark, d, "part").select(text.ascii_lower("p_name").alias("name")).distinct()


def _stream(spark, d, name: str) -> DataFrame:
    rows = table(spark, d, name)
    # a pattern, since the file source takes a plain path for a directory
    return spark.readStream.schema(rows.schema).parquet(f"{d}/{name}.parque[t]")


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives on the files there are now, as a table in the shared folder: nothing of it is held by the driver.

    Each micro-batch is a folder, written anew if it is run again; in complete mode
    the last one holds all. State is kept in RocksDB, on the executors' disks.
    """
    spark = df.sparkSession
    path = tables.new_path(spark, "stream")
    tables.goes_at_exit(spark, path)
    setting, batches = "spark.sql.streaming.stateStore.providerClass", []
    before = spark.conf.get(setting)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/out/{n}")
        batches.append(f"{path}/out/{n}")

    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(setting, before)
    last = dict.fromkeys(batches) if mode == "append" else batches[-1:]
    return spark.read.schema(df.schema).parquet(*last) if last else spark.createDataFrame([], df.schema)


@query(ORACLES["throttle_per_phase"].replace("len(ev)::BIGINT AS events FROM f", "FROM f").replace("s.kept AS kept, ", "s.kept AS kept "))
def stream_throttle(spark, d):
    """The streaming throttle over all events in one micro-batch: as many pass as in the batch form."""
    rows = _stream(spark, d, "events").withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    passed = _drained(streams.throttled(rows, "user_id", "event_type", "seconds", "event_id", 3600.0), "append")
    return passed.groupBy("user_id").agg(F.count("*").alias("kept"))


@query("SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS day, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    rows = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(streams.windowed_counts(rows, "user_id", "ts", "1 day", "1 hour"), "complete")
    return out.select("user_id", F.floor(F.unix_timestamp("start") / 86400).alias("day"), "n")


@query(ORACLES["session_runs"])
def stream_sessions(spark, d):
    rows = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(streams.sessions(rows, "user_id", "ts", "4 hours", "1 hour"), "complete")
    return out.select("user_id", "n", F.unix_timestamp("start").alias("first"))
