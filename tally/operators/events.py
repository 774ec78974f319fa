"""Event logs, polls and scans that resume, as tables; JSON rows and their quarantine."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replayable(events: DataFrame, by: Sequence[str], seq: str, size: int, transient: Column) -> DataFrame:
    """The last events of each channel that can be replayed; transient ones never are."""
    w = Window.partitionBy(*by).orderBy(F.col(seq).desc())
    return events.where(~transient).withColumn("place", F.row_number().over(w)).where(F.col("place") <= size).drop("place")


def resumes(ring: DataFrame, clients: DataFrame, by: Sequence[str], seq: str, epoch: str, behind: int) -> DataFrame:
    """by, client, missed, complete, closed: what each client (by, client, last, seen_epoch) gets.

    Incomplete if events after its last one were evicted or its epoch is another;
    closed if more than ``behind`` events wait for it.
    """
    bounds = ring.groupBy(*by).agg(F.min(seq).alias("low"), F.max(seq).alias("high"), F.max(epoch).alias("now"))
    rows = clients.join(bounds, list(by), "left")
    same = F.col("seen_epoch").eqNullSafe(F.col("now"))
    complete = same & (F.col("last") + 1 >= F.col("low"))
    waiting = ring.join(clients.select(*by, "client", "last"), list(by)).where(F.col(seq) > F.col("last")).groupBy(*by, "client").agg(F.count("*").alias("missed"))
    rows = rows.join(waiting, [*by, "client"], "left").withColumn("missed", F.coalesce("missed", F.lit(0)))
    return rows.select(*by, "client", "missed", F.coalesce(complete, F.lit(False)).alias("complete"), (F.col("missed") > behind).alias("closed"))


def coalesced(events: DataFrame, by: Sequence[str], time: str, quiet: float) -> DataFrame:
    """by, at, n: bursts of events, one signal each, ``quiet`` seconds after their last."""
    w = Window.partitionBy(*by).orderBy(time)
    marked = events.withColumn("new", F.coalesce(F.col(time) - F.lag(time).over(w) >= quiet, F.lit(True)).cast("int"))
    bursts = marked.withColumn("burst", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return bursts.groupBy(*by, "burst").agg((F.max(time) + quiet).alias("at"), F.count("*").alias("n")).drop("burst")


def cadence(polls: DataFrame, by: Sequence[str], order: str, ok: str, usual: int, slow: int, most: int = 3) -> DataFrame:
    """polls with the wait after each: the usual one, the slow one from the ``most``-th failure in a row on."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = polls.withColumn("run", F.sum(F.col(ok).cast("int")).over(w))
    failures = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(*by, "run").orderBy(order))
    return runs.withColumn("wait", F.when(failures >= most, slow).otherwise(usual)).drop("run")


def resumed_scan(units: DataFrame, done: DataFrame, unit: str) -> DataFrame:
    """Units of an interrupted scan that are still to do."""
    return units.join(done.select(unit).distinct(), unit, "left_anti")


def deferred_deletes(stored: DataFrame, seen: DataFrame, keys: Sequence[str], finished: bool) -> DataFrame:
    """Rows that go at the end of a scan: those no unit has seen; none while units are left."""
    return stored.join(seen.select(*keys).distinct(), list(keys), "left_anti") if finished else stored.limit(0)


def stale(sources: DataFrame, stamps: DataFrame, by: str, stored: str, stamp: str) -> DataFrame:
    """Sources whose stored stamp is not the present one of their domain."""
    return sources.join(stamps.select(by, F.col(stamp).alias("present")), by, "left").where(~F.col(stored).eqNullSafe(F.col("present"))).drop("present")


def index_damage(table: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(missing, orphaned): rows that a derived index lacks, and entries of it without a row."""
    missing = table.select(*columns).exceptAll(index.select(*columns)).agg(F.count("*").alias("missing"))
    return missing.crossJoin(index.select(*columns).exceptAll(table.select(*columns)).agg(F.count("*").alias("orphaned")))  # one row each


def doctor(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, value, ok) of named checks, each a one-row table (value, ok)."""
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("check"), F.col("value").cast("double").alias("value"), "ok")
        out = row if out is None else out.unionByName(row)
    return out


def json_rows(df: DataFrame, columns: Sequence[str], name: str = "document") -> DataFrame:
    """df with the columns as one JSON object, nulls kept."""
    return df.withColumn(name, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def read_json(df: DataFrame, column: str, schema: StructType | str, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows with the fields, quarantine with the reason): documents that are no JSON, or whose required fields are missing or of another type, go apart."""
    parsed = df.withColumn("doc", F.from_json(column, schema, {"mode": "PERMISSIVE"})).withColumn("whole", F.try_parse_json(column).isNotNull())
    lacking = F.lit(None).cast("string")
    for c in reversed(required):
        lacking = F.when(F.col(f"doc.{c}").isNull(), F.lit(f"field {c}")).otherwise(lacking)
    reason = F.when(~F.col("whole"), "not json").otherwise(lacking)
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason is null").select(*df.columns, "doc.*"), marked.where("reason is not null").select(*df.columns, "reason")


def tagged(tag: Column, cases: Mapping[str, Sequence[str]], name: str = "code") -> Column:
    """A tagged union as JSON: the tag, and the fields of its case alone."""
    out = F.lit(None).cast("string")
    for case, fields in cases.items():
        out = F.when(tag == case, F.to_json(F.struct(tag.alias(name), *fields))).otherwise(out)
    return out


def tag_of(column: str, cases: Mapping[str, Sequence[str]], name: str = "code") -> Column:
    """The tag of a tagged union; null for an unknown one or where a field of its case is missing."""
    tag, out = F.get_json_object(column, f"$.{name}"), F.lit(None).cast("string")
    for case, fields in cases.items():
        whole = F.lit(True)
        for f in fields:
            whole = whole & F.get_json_object(column, f"$.{f}").isNotNull()
        out = F.when((tag == case) & whole, tag).otherwise(out)
    return out
