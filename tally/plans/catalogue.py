"""The test tables read as a catalogue: entries, items, groups, offers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import entry_completeness, group_summary, mask_sets
from ..operators.pick import pick

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def satisfied():
    return (F.col("l_linestatus") == "F") | (F.col("l_returnflag") == "R")


def priority_bit():
    return F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(5)]), F.substring("o_orderpriority", 1, 1).cast("int"))


def status_bit():
    return F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(4).cast("long")


_kept: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that is kept while the session lasts and its source files stay the same.

    A service would hold these as tables that groups.refresh keeps up to date; pages read them alone.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stamp = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept or _kept[key][0] != stamp:
        if key in _kept:
            _kept[key][1].unpersist()
        _kept[key] = (stamp, build().persist())
    return _kept[key][1]


def entries(spark: SparkSession, sf_dir: str, live: bool = True) -> DataFrame:
    """orders as entries: entry, root, domain, bits, completeness."""
    return stored(spark, sf_dir, f"entries-{live}", lambda: _entries(spark, sf_dir, live))


def _entries(spark: SparkSession, sf_dir: str, live: bool) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    if live:
        orders = orders.where("o_orderstatus <> 'P'")
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("domain"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus", "l_returnflag")
    done = entry_completeness(orders, items, "o_orderkey", satisfied())
    return done.join(nations, "o_custkey").select(
        F.col("o_orderkey").alias("entry"), F.col("o_custkey").alias("root"), "domain", priority_bit().alias("bit"), status_bit().alias("region_bit"),
        (F.col("o_orderpriority") == "1-URGENT").alias("wanted"), "n", "ok", "complete", "o_orderpriority", "o_totalprice", "o_orderdate",
    )


def pick_order():
    return [F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderdate").asc(), F.col("entry").asc()]


def groups(spark: SparkSession, sf_dir: str, variants: DataFrame | None = None) -> DataFrame:
    """One row a group with its pick."""
    if variants is None:
        return stored(spark, sf_dir, "groups", lambda: groups(spark, sf_dir, entries(spark, sf_dir)))
    v = variants
    summary = group_summary(v, ["root", "domain"], flagless=0b11000)
    picks = pick(v, ["root", "domain"], pick_order()).select("root", "domain", F.col("entry").alias("pick_id"))
    return summary.join(picks, ["root", "domain"])


def browsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table that pages read: groups with their names and their variants' masks."""

    def build() -> DataFrame:
        names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"), F.col("c_name").alias("name"))
        return groups(spark, sf_dir).join(names, "root").join(mask_sets(entries(spark, sf_dir), ["root", "domain"]), ["root", "domain"])

    return stored(spark, sf_dir, "browsed", build)


ENTRIES_SQL = """
counts AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F' OR l_returnflag = 'R') AS ok FROM lineitem GROUP BY 1),
entries AS (
  SELECT o_orderkey AS entry, o_custkey AS root, c_nationkey AS domain, (1 << (substr(o_orderpriority, 1, 1)::INT - 1))::BIGINT AS bit,
    (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END)::BIGINT AS region_bit, o_orderpriority = '1-URGENT' AS wanted,
    coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(n > 0 AND n = ok, false) AS complete, o_orderpriority, o_totalprice, o_orderdate, o_orderstatus
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN counts ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
),
picks AS (SELECT root, domain, entry AS pick_id FROM entries QUALIFY row_number() OVER (PARTITION BY root, domain ORDER BY o_orderpriority, o_totalprice DESC, o_orderdate, entry) = 1),
groups AS (
  SELECT root, domain, count(*) AS variants, count(*) FILTER (WHERE complete) AS have, count(*) FILTER (WHERE wanted) AS wanted, max(entry) AS newest_id,
    min(bit) AS lean_flags, bit_or(bit) AS flag_union, bit_or(region_bit) AS region_union,
    bit_or(CASE WHEN bit & ~24 = bit THEN region_bit ELSE 0 END)::BIGINT AS unflagged_regions
  FROM entries GROUP BY root, domain
),
full_groups AS (SELECT g.*, p.pick_id FROM groups g JOIN picks p USING (root, domain))
"""
