"""Mixing sources to target weights, on DataFrame functions alone.

Each source has a size (its words). Targets share the sum of all sizes by
weight; a target stops at ``max_rate`` times its source's size and what is over
goes to the others by weight, until none is above. A document of a source with
rate r = target / size is emitted floor(r) times, and once more with
probability r - floor(r), decided by a hash of the seed and its doc_id.

Defined results: a null text has size 0; null sources are one source, last in
order; rows of the same doc_id decide alike, a null doc_id decides as the text
"null"; a source without words has target 0 and emits nothing; an empty table
gives an empty result. Columns beside doc_id, text and source pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import word_count, written

WEIGHTS = (5, 2, 1)
MAX_RATE = 3
SEED = "mix-1"
#: Sources up to which the table of rates (a name and a few numbers each) is broadcast.
BROADCAST_SOURCES = 100_000
#: Copies of the rates, and parts of each source, in the join beyond that.
SALTS = 32


def targets(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    The water level is found without iteration: sources in order of the level
    at which they stop are full up to the first that the level does not fill.
    The windows hold one row a source, never a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long").alias("weight"),
        F.row_number().over(by_name).alias("turn"),
    )
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "turn")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    steps = weighed.select(
        "*",
        F.row_number().over(by_level).alias("step"),
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(max_rate * F.col("source_size")).over(before), F.lit(0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("share"),
    )
    left = (F.col("total") - F.col("full")).cast("double")
    stops = F.lit(float(max_rate)) * F.col("source_size") * F.col("share") <= F.col("weight") * left
    first = F.min(F.when(~stops, F.struct("step", left.alias("left"), F.col("share").cast("double").alias("share")))).over(everything)
    level = steps.select("source", "source_size", "weight", "step", first.alias("first"))
    share = F.col("weight") * F.col("first.left") / F.col("first.share")
    kept = F.col("first").isNull() | (F.col("step") < F.col("first.step"))
    return level.select("source", "source_size", "weight", F.when(kept, F.lit(float(max_rate)) * F.col("source_size")).otherwise(share).alias("target"))


def chance(doc_id: Column | str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed and the doc_id: 52 bits of an MD5."""
    key = F.concat(F.lit(seed + ":"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(rate: Column, doc_id: Column | str, seed: str = SEED) -> Column:
    return (F.floor(rate) + (chance(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def _with_rates(rows: DataFrame, rates: DataFrame, max_rate: int) -> DataFrame:
    """rows (doc, source, part) with source_size, target and rate of their source; ``part`` deals out the rows of a source."""
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_rate)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    # `is null` beside the name makes an equi-join of the null-safe comparison
    keys = ["source", "no_source"]
    rates = rates.select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source"), "source_size", "target", rate.alias("rate"))
    rows = rows.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    if rates.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(rates), keys)
    salted = rates.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, [*keys, "part"])


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row of docs."""
    sized = written(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    rates = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_rate), "mix-rates")
    rows = sized.select(F.struct("*").alias("doc"), "source", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("part"))
    n = copies(F.col("rate"), F.col("doc.doc_id"), seed)
    return _with_rates(rows, rates, max_rate).select(
        "doc.doc_id", "doc.source", "doc.size", "source_size", "target", "rate", n.alias("copies"), (F.col("doc.size") * n).alias("taken"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs, whatever their names."""
    sizes = docs.groupBy("source").agg(F.sum(word_count("text")).alias("source_size"))
    rates = written(targets(sizes, weights, max_rate), "mix-rates")
    rows = docs.select(F.struct("*").alias("doc"), "source", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("part"))
    n = copies(F.col("rate"), F.col("doc.doc_id"), seed).cast("int")
    taken = _with_rates(rows, rates, max_rate).withColumn("n", n).where("n > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sources
), steps AS (
  SELECT *, row_number() OVER w AS step, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS gone,
    ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS share
  FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, turn)
), first AS (
  SELECT step AS first_step, (total - gone)::DOUBLE AS rest, share::DOUBLE AS share FROM steps
  WHERE NOT (3.0::DOUBLE * source_size * share <= weight * (total - gone)::DOUBLE) ORDER BY step LIMIT 1
), target AS (
  SELECT source, source_size, CASE WHEN first_step IS NULL OR step < first_step THEN 3.0::DOUBLE * source_size ELSE weight * rest / f.share END AS target
  FROM steps LEFT JOIN first f ON true
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
