"""Views and pages on a generated catalogue."""

import pytest
from pyspark.sql import functions as F

from tally import schema as S
from tally.operators.browse import Filter
from tally.plans import api, views


@pytest.fixture(scope="module")
def tables(spark):
    """A deterministic catalogue: 60 entries in 20 groups on 2 domains, two items each, files in several states."""
    n = 60
    i = spark.range(n)
    entries = i.select(
        F.col("id"), (F.col("id") % 2).alias("domain"), (F.col("id") % 3).alias("version_id"), F.concat(F.lit("Game "), F.floor(F.col("id") / 3), F.lit(" (V"), F.col("id") % 3, F.lit(")")).alias("name"),
        F.concat(F.lit("Game "), F.floor(F.col("id") / 3)).alias("base_name"), F.lit(None).cast("long").alias("parent_id"), (F.floor(F.col("id") / 3) * 3).alias("group_root"), F.lit(None).cast("string").alias("revision"),
        (F.col("id") % 3 == 0).alias("is_pick"), (F.col("id") % 5 == 0).alias("wanted"), (F.col("id") % 11 == 10).alias("retired"), F.lit(None).cast("string").alias("clone_of"), F.lit("k").alias("group_key"), F.lit(False).alias("inferred"),
        F.lit(0).cast("tinyint").alias("source"), F.lit(None).cast("string").alias("setname"), F.lit(None).cast("string").alias("path"), F.when(F.col("id") % 7 == 0, 3).cast("tinyint").alias("check"), F.lit(None).cast("long").alias("seen"),
    )
    items = spark.range(2 * n).select(
        F.col("id"), F.floor(F.col("id") / 2).alias("entry_id"), F.lit(False).alias("own_name"), F.concat(F.lit("."), F.col("id")).alias("name"), (F.col("id") * 10).alias("size"), F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("crc32"),
        F.lit(None).cast("binary").alias("md5"), F.lit(None).cast("binary").alias("sha1"), (F.col("id") % 4).cast("tinyint").alias("status"), F.lit(False).alias("retired"), F.lit(None).cast("string").alias("match_name"),
        F.lit(None).cast("string").alias("match_base"), F.lit(None).cast("string").alias("header"), F.lit(None).cast("string").alias("zip_dir"), (F.col("id") % 6 == 5).alias("present"),
    )
    files = spark.range(100).select(
        F.col("id"), (F.col("id") % 2).alias("domain"), F.concat(F.lit("f/"), F.col("id")).alias("rel_path"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("mtime"), *[F.lit(None).cast("binary").alias(c) for c in ("crc32", "md5", "sha1")],
        F.lit(0).cast("tinyint").alias("header_rule"), F.when(F.col("id") % 6 != 5, F.col("id")).alias("item_id"), F.when(F.col("id") % 6 == 5, 5).when(F.col("id") % 4 == 3, 2).otherwise(1).cast("tinyint").alias("state"),
        F.lit(1).cast("long").alias("scanned_at"), F.when(F.col("id") % 6 == 5, 2).cast("tinyint").alias("reason"),
    )
    tags = spark.createDataFrame([(1, 0, "beta", 2), (2, 1, "USA", 1), (3, 1, "Mars", None), (4, 0, "bios", 8)], S.schema("tags"))
    links = entries.select(F.col("id").alias("entry_id"), F.lit(0).alias("pos"), (F.col("id") % 4 + 1).alias("tag_id"))
    domains = spark.createDataFrame([(0, "a", "A", 0, True), (1, "b", "B", 1, True)], S.schema("domains"))
    offers = spark.range(50).select(F.lit(1).cast("long").alias("source_id"), F.col("id").cast("int").alias("file_index"), F.concat(F.lit("d/F"), F.col("id")).alias("path"), F.col("id").alias("size"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("item_id"), F.when(F.col("id") % 5 == 0, 1).cast("tinyint").alias("confidence"))
    candidates = spark.createDataFrame([(1, 3, 7, 3), (1, 5, 8, 4)], S.schema("candidates"))
    transfers = spark.createDataFrame([(1, 1, 1, 1, 3, 5, 1.0, None, 1, 1), (2, 1, 1, 1, 3, 2, 0.5, None, 2, 2), (3, 1, 1, 1, 4, 5, 1.0, None, 3, 3)], S.schema("transfers"))
    sources = spark.createDataFrame([(1, "ab", "S", "o", 0, 0.7, 2, None, 0, None, 50, 1, None, 9, None, False)], S.schema("sources"))
    jobs = spark.createDataFrame([(k, 1, "{}", 3 if k != 4 else 4, None, k, k, 0, "s") for k in range(8)] + [(9, 1, "{", 0, None, 9, 9, 0, "s")], S.schema("jobs"))
    return {"entries": entries, "items": items, "files": files, "tags": tags, "entry_tags": links, "domains": domains, "offers": offers, "candidates": candidates, "transfers": transfers, "sources": sources, "jobs": jobs}


@pytest.fixture(scope="module")
def groups(tables):
    return views.group_summaries(*(tables[t] for t in ("entries", "items", "files", "entry_tags", "tags")), known_flags=0b1010).cache()


def test_codes(spark):
    got = spark.createDataFrame([(0,), (5,), (9,), (None,)], "c tinyint").select(S.word("c", S.FILE_STATE)).collect()
    assert [r[0] for r in got] == ["pending", "unidentified", None, None]
    back = spark.createDataFrame([("bad",), ("x",)], "w string").select(S.code("w", S.FILE_STATE)).collect()
    assert [r[0] for r in back] == [4, None]


def test_views(tables):
    v = views.item_view(tables["items"], tables["entries"], tables["entry_tags"], 4)
    one = v.where("id = 7").first()
    assert (one["name"], one["crc32_hex"], one["status_text"], one["live"], one["bios"]) == ("Game 1 (V0).7", "00000007", "verified", True, True)
    assert views.live_item_view(tables["items"], tables["entries"], tables["entry_tags"], 4).where("bios or not live").count() == 0
    f = views.file_view(tables["files"], tables["domains"]).where("id = 5").first()
    assert (f["state_text"], f["reason_text"], f["domain_slug"]) == ("unidentified", "no_layout", "b")
    assert views.tag_lists(tables["entry_tags"], tables["tags"], "region").where("entry_id = 1").first()["regions"] == ["USA"]


def test_group_summary_against_plain_python(tables, groups):
    e, i, f = ([r.asDict() for r in tables[t].collect()] for t in ("entries", "items", "files"))
    held = {r["item_id"] for r in f if r["state"] == 1}
    want = {}
    for r in e:
        if r["retired"]:
            continue
        mine = [x for x in i if x["entry_id"] == r["id"]]
        ok = [x["id"] in held or (x["present"] and (r["check"] or 0) < 2) for x in mine]
        w = want.setdefault((r["group_root"], r["domain"]), [0, 0, 0, None])
        w[0] += 1
        w[1] += bool(ok) and all(ok)
        w[2] += r["wanted"]
        w[3] = r["id"] if r["is_pick"] else w[3]
    assert {(r["root"], r["domain"]): [r["variants"], r["have"], r["wanted"], r["pick_id"]] for r in groups.collect()} == want
    assert all(r["split"] == (r["root"] % 2 != r["domain"]) for r in groups.collect())


def test_pages(tables, groups):
    page, total = api.domains(tables, groups)
    assert [r["slug"] for r in page.collect()] == ["a", "b"] and total.first()["total"] == 2
    page, total = api.unidentified(tables, 1, limit=3)
    assert page.count() == 3 and total.first()["total"] == 16
    page, total = api.offers(tables, 1, matched=True)
    assert [r["file_index"] for r in page.collect()] == [0, 3, 5, 10, 15, 20, 25, 30, 35, 40, 45] and total.first()["total"] == 11
    assert api.offers(tables, 1, search="f3")[0].where("file_index = 3").first()["transfer"] == "transferring"
    assert api.sources(tables)[0].first()["matched"] == 11
    assert api.transfers(tables, ["done"])[1].first()["total"] == 2
    assert [r["n"] for r in api.recent_jobs(tables).collect()] == [3, 1, 4]
    assert api.active_jobs(tables)[1].first()["total"] == 1
    variants = tables["entries"].where("not retired").select(F.col("group_root").alias("root"), "domain", F.lit(0).cast("long").alias("bit"), F.lit(1).cast("long").alias("region_bit"))
    page, total = api.entries(groups, variants, 0, Filter(search="game 1", have=None))
    assert total.first()["total"] == groups.where("domain = 0 and lower(base_name) like '%game 1%'").count()
    one = api.entry(tables, groups, 3).first()
    assert [v["entry_id"] for v in one["members"]] == [3, 4, 5]


def test_changes(spark, tables):
    after = api.cancel(tables, spark.createDataFrame([(1,), (2,)], "id bigint"), 99)
    assert {r["id"]: (r["state"], r["updated_at"]) for r in after.collect()} == {1: (5, 1), 2: (8, 99), 3: (5, 3)}
    loaded = api.load_version(tables, tables["entries"].where("id < 30").select("name"), 0)
    assert loaded.where("version_id = 0 and retired").count() == 10 and loaded.count() == 60


def test_constraints(tables):
    broken = {(r["table"], r["rule"]): r["broken"] for t in ("items", "files", "sources", "transfers", "jobs") for r in S.report(tables[t], t).collect()}
    assert broken[("jobs", "payload")] == 1
    assert sum(broken.values()) == 1
