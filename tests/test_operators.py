from pyspark.sql import functions as F

from tally.operators import bind, diff, groups, loads, match, pick, relational, state
from tally.sources import files as fs


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_reroot_prefers_live(spark):
    nodes = df(spark, [(1, 1, True), (2, 1, True), (5, 9, False), (6, 9, True), (7, 8, False)], "n int, t int, live boolean")
    got = {r["n"]: r["root"] for r in groups.reroot(nodes, "n", "t", F.col("live")).collect()}
    assert got == {1: 1, 2: 1, 5: 6, 6: 6, 7: 7}


def test_refresh_equals_full(spark):
    """Random inserts, deletes and changes: the refreshed summary is the full one."""
    import random

    rng = random.Random(3)
    now = {k: (k % 7, rng.randrange(4)) for k in range(60)}
    total = lambda d: d.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    frame = lambda x: df(spark, [(k, *v) for k, v in x.items()], "k int, g int, v int")
    for _ in range(3):
        after = {k: v for k, v in now.items() if rng.random() > 0.1} | {rng.randrange(90): (rng.randrange(9), 1) for _ in range(5)}
        old, new = frame(now), frame(after)
        dirty = groups.changed_keys(old, new, ["g"])
        fresh = groups.refresh(total(old), dirty, ["g"], lambda k, new=new: total(new.join(k, "g", "left_semi")))
        assert sorted(fresh.collect()) == sorted(total(new).collect())
        now = after


def test_assign_distinct(spark):
    payloads = df(spark, [(1, 1, 10, "a", None), (1, 2, 10, "b", None), (1, 3, 10, "x", 100)], "e int, p int, size int, leaf string, prefer int")
    items = df(spark, [(1, 100, 10, "a"), (1, 101, 10, "b"), (1, 102, 10, "c"), (1, 103, 99, "x")], "e int, i int, size int, leaf string")
    got = sorted(tuple(r) for r in match.assign_distinct(payloads, items, "e", "p", "i", ["size"], "leaf").collect())
    assert got == [(1, 1, 100), (1, 2, 101), (1, 3, 102)]


def test_all_or_nothing(spark):
    c = df(spark, [("g", 1, 7), ("g", 2, 7), ("g", 1, 8), ("g", 1, 5), ("g", 2, 5)], "g string, track int, entry int")
    t = df(spark, [("g", 1), ("g", 2)], "g string, track int")
    n = df(spark, [(7, 2), (8, 2), (5, 3)], "entry int, n bigint")
    assert [tuple(r) for r in match.all_or_nothing(c, t, "g", "track", "entry", n).collect()] == [("g", 7)]


def test_not_in_null_rules(spark):
    left = df(spark, [(1,), (2,), (None,)], "a int")
    assert relational.not_in(left, df(spark, [(1,), (None,)], "b int"), "a", "b").count() == 0
    assert relational.not_in(left, df(spark, [], "b int"), "a", "b").count() == 3


def test_preferences(spark):
    rows = df(spark, [(["USA"],), (["Japan", "Europe"],), ([],), (["Mars"],)], "r array<string>")
    assert [x[0] for x in rows.select(pick.list_rank(F.col("r"), ["Europe", "USA"])).collect()] == [2, 1, 3, 3]
    assert [x[0] for x in rows.select(pick.language_rank(F.col("r"), ["USA"])).collect()] == [0, 2, 1, 2]


def test_numbered_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = diff.numbered(rows, ["k"], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


def test_numbered_in_ranges(spark, monkeypatch):
    """Beyond one task's rows: ranges by bounds, with repeated keys and several columns."""
    monkeypatch.setattr(diff, "ONE_TASK", 100)
    rows = spark.range(1000).select((F.col("id") * 7 % 1000 % 10).alias("a"), F.concat(F.lit("k"), F.col("id")).alias("b"))
    got = diff.numbered(rows, ["a", "b"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(1, 1001))
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted((r["a"], r["b"]) for r in got)


def test_fold_in_pieces(spark, monkeypatch):
    """A key's events are folded in pieces that compose."""
    import random

    monkeypatch.setattr(state, "FOLD", 3)
    moves, rng = {("a", "x"): "b", ("b", "y"): "c", ("c", "x"): "a", ("b", "z"): "a"}, random.Random(1)
    rows = [(k, n, rng.choice("xyz")) for k in range(4) for n in range(k * 9 + 1)]
    got = state.fold_events(df(spark, rows, "k int, n int, e string"), ["k"], ["n"], "e", "a", moves).collect()
    for r in got:
        now, moved = "a", 0
        for _, _, e in sorted(x for x in rows if x[0] == r["k"]):
            to = moves.get((now, e))
            now, moved = to or now, moved + bool(to)
        assert (r["state"], r["moves"], r["events"]) == (now, moved, r["k"] * 9 + 1)


def test_compare_and_set(spark):
    rows = df(spark, [(1, "queued"), (2, "done"), (3, "queued")], "id int, state string")
    delta = df(spark, [(1, "queued", "running"), (2, "queued", "running"), (3, "queued", "done")], "id int, `from` string, `to` string")
    got = state.compare_and_set(rows, delta, "id", "state", {"queued": ["running"]})
    assert {r["id"]: r["state"] for r in got.collect()} == {1: "running", 2: "done", 3: "queued"}


def test_bind_threshold(spark):
    scored = df(spark, [(1, 5, 0.7, 1), (2, 6, 0.5, 1)], "source int, domain int, score double, rank int")
    assert {r["source"]: r["bound"] for r in bind.bind(scored, "source", "domain").collect()} == {1: 5, 2: None}


def test_zip_location(spark):
    rows = df(spark, [("a.zip",), ("/x/../y.zip",), ("../../b.zip",)], "z string")
    assert [r[0] for r in rows.select(fs.zip_location(F.col("z"))).collect()] == ["mame/a.zip", "y.zip", "b.zip"]


def test_expire_needs_both(spark):
    ops = df(spark, [(25, 10.0), (25, 9e4), (1, 9e4)], "tries int, age double")
    assert state.expire(ops, "tries", "age").count() == 2


def test_rematch_meets_one_item_a_hash(spark):
    """Hits do not grow with files times items of a hash; the least live item of the strongest hash is the match."""
    hashes = ["cast(null as bigint) as size", "cast(null as bigint) as crc32"]
    files = spark.range(1000).selectExpr("id", *hashes, "if(id % 2 = 0, id % 3, null) as md5", "if(id % 5 = 0, id % 2, null) as sha1")
    items = spark.range(1000).selectExpr("id", *hashes, "id % 3 as md5", "if(id % 7 = 0, id % 2, null) as sha1", "id < 10 as retired")
    got = loads.rematch_stored(files, items)
    live = items.where("not retired").collect()
    want = set()
    for f in files.collect():
        for tier, k in enumerate(("sha1", "md5")):
            hit = [i["id"] for i in live if f[k] is not None and i[k] == f[k]]
            if hit:
                want.add((f["id"], min(hit), tier))
                break
    assert {tuple(r) for r in got.collect()} == want and len(want) == 600
    # rows that reach the last pick: at most one for each file and tier
    joins = [n for n in spark_nodes(got) if n.nodeName().endswith("Join")]
    assert joins and all(n.metrics().apply("numOutputRows").value() <= 1000 for n in joins)


def spark_nodes(df):
    """Physical operators of a collected frame, with their metrics."""
    found = []

    def walk(n):
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(n.executedPlan())
        if "QueryStage" in name:
            return walk(n.plan())
        found.append(n)
        for k in range(n.children().size()):
            walk(n.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_numbered_sorts_once(spark, monkeypatch):
    """Beyond one task's rows, numbers are read from a table with ranges: no look at all bounds for each row, no second sort."""
    monkeypatch.setattr(diff, "ONE_TASK", 100)
    rows = spark.range(1000).select(F.when(F.col("id") % 50 != 0, F.col("id") * 7 % 1000).alias("k"), "id")
    got = diff.numbered(rows, ["k", "id"], "n")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.inputFiles() and "lambda" not in plan and "row_number" not in plan
    key = lambda r: (r["k"] is not None, r["k"], r["id"])  # noqa: E731  nulls first
    want = sorted(rows.collect(), key=key)
    assert [(r["k"], r["id"]) for r in sorted(got.collect(), key=lambda r: r["n"])] == [tuple(r) for r in want]
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 1001)) and got.schema["n"].dataType.typeName() == "long"
