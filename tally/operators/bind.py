"""Which domain an unlabelled list belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import first_per_key

THRESHOLD = 0.6


def domain_hits(matches: DataFrame, source: str, domain: str, offer: Sequence[str]) -> DataFrame:
    """Distinct offers of each source that match in each domain."""
    return matches.select(source, domain, *offer).distinct().groupBy(source, domain).agg(F.count("*").alias("hits"))


def scores(hits: DataFrame, totals: DataFrame, source: str, domain: str) -> DataFrame:
    """hits / total, ranked in each source; ties to the lower domain."""
    w = Window.partitionBy(source).orderBy(F.desc("score"), F.col(domain))
    return hits.join(totals, source).withColumn("score", F.col("hits") / F.col("total")).withColumn("rank", F.row_number().over(w))


def bind(scored: DataFrame, source: str, domain: str, threshold: float = THRESHOLD) -> DataFrame:
    """The winning domain of each source, null below the threshold."""
    best = scored.where(F.col("rank") == 1)
    return best.select(source, F.when(F.col("score") >= threshold, F.col(domain)).alias("bound"), "score")


def bind_and_map(matches: DataFrame, bound: DataFrame, source: str, domain: str, offer: str, order: Sequence[Column]) -> DataFrame:
    """Matches in the winning domain: the first of each offer, and the others of the same tier as extras."""
    won = bound.where("bound is not null").select(source, F.col("bound").alias(domain))
    rows = matches.join(won, [source, domain])
    w = Window.partitionBy(source, offer).orderBy(F.col("tier"), *order)
    ranked = rows.withColumns({"place": F.row_number().over(w), "_least": F.min("tier").over(Window.partitionBy(source, offer))})
    return ranked.where(F.col("tier") == F.col("_least")).withColumn("extra", F.col("place") > 1).drop("_least")


def map_to(matches: DataFrame, domain: str, value, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first match of each offer in one given domain."""
    return first_per_key(matches.where(F.col(domain) == F.lit(value)), keys, [F.col("tier"), *order])


def majority_directories(paths: DataFrame, source: str, path: str) -> DataFrame:
    """Directories that at least half of a source's paths go through."""
    totals = paths.groupBy(source).agg(F.count("*").alias("n"))
    parts = F.split(F.col(path), "/")
    dirs = paths.select(source, F.explode(F.array_distinct(F.slice(parts, 1, F.size(parts) - 1))).alias("dir")).where("dir != ''")
    counted = dirs.groupBy(source, "dir").agg(F.count("*").alias("files")).join(totals, source)
    return counted.where(2 * F.col("files") >= F.col("n")).select(source, "dir", "files")


def unanimous(hints: DataFrame, source: str, domain: str, weight: str) -> DataFrame:
    """The domain of the most hints, where no other has as many."""
    counted = hints.groupBy(source, domain).agg(F.sum(weight).alias("_w"))
    top = F.max("_w").over(Window.partitionBy(source))
    best = counted.withColumn("_top", top).where(F.col("_w") == F.col("_top"))
    return best.groupBy(source).agg(F.when(F.count("*") == 1, F.max(domain)).alias(domain))


def longest_pattern(names: DataFrame, name: str, patterns: DataFrame, domain: str, pattern: str) -> DataFrame:
    """The domain of the longest pattern that a name holds as whole words; ties in table order.

    Names are cut into runs of as many words as patterns have, so that both meet in an equi-join.
    """
    most = patterns.agg(F.max(F.size(F.split(pattern, " ")))).first()[0] or 0
    words = F.split(F.col(name), " ")
    runs = lambda k: F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))
    cut = names.select(name, F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[runs(k) for k in range(1, most + 1)]))).alias("_run"))
    hits = cut.join(patterns, F.col("_run") == F.col(pattern))
    return first_per_key(hits, [name], [F.length(pattern).desc(), F.col("place")]).select(name, domain)
