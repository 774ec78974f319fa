"""Helpers shared by the training-data operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import _names, drop_table, goes_at_exit, new_path, shuffles_go, written  # noqa: F401  used by the operators here

#: One word, everywhere in this subpackage: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of a plan's estimated output that a bucket is to hold, the most buckets Spark allows, and estimates that say nothing (Spark's default is 8 EB).
BUCKET_BYTES, MOST_BUCKETS, NO_ESTIMATE = 128 << 20, 100_000, 1 << 58


def bucket_count(df: DataFrame) -> int:
    """Buckets for a table of df: as many as shuffle partitions, more where Spark's estimate of its bytes asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= NO_ESTIMATE else max(least, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))


def written_by(df: DataFrame, label: str, key: str, n: int) -> DataFrame:
    """df as a table in n buckets of a key: later joins and sums by the key alone need no shuffle of it.

    The rows are not shuffled here either; to have few files, deal them out by the key first.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = "tally_" + path.rsplit("-", 1)[1]
    with shuffles_go(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    _names.append((spark, name))
    goes_at_exit(spark, path)
    return spark.table(name)


def least(rows: DataFrame, n: int, count: int, *by: str) -> DataFrame:
    """The n rows of least hash of ``by`` among count rows; ties by these columns.

    Rows far above the hash that some 8 n rows fall under are filtered first, so that
    what is sorted and sent does not grow with the number of partitions.
    """
    h = F.xxhash64(*by)
    if count > 8 * n:
        bound = -(1 << 63) + int((1 << 64) * 8 * n / count)
        few = rows.where(h < F.lit(min(bound, (1 << 63) - 1)))
        # repeated rows share a hash: only a sample that is large enough is taken from below the bound
        if few.limit(n).count() == n:
            rows = few
    return rows.orderBy(h, *by).limit(n)


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, with underscores before those that a table already has in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def signed(mask: int) -> Column:
    """64 bits as the long that Spark holds them in."""
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def parts(bits: list[int], n: int) -> list[int]:
    """Masks of n parts of a list of bit numbers, as even as can be."""
    return [sum(1 << b for b in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def block_masks(budget: int, agree: int) -> list[int]:
    """Masks of which one at least holds no differing bit of any pair within the budget: all choices of so many of budget + agree blocks."""
    return [sum(chosen) for chosen in combinations(parts(list(range(64)), budget + agree), agree)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column | str) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
