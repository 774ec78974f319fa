"""Fuzzy matches between records of equal size, by the words of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_sequel

MOST_GROUPS = 4


def signal(file: Column, item: Column) -> Column:
    """3: equal words; 2: the same letters run together; 1: a proper prefix that no sequel word follows; else null."""
    joined = F.array_join(file, "") == F.array_join(item, "")
    n = F.size(file)
    prefix = (F.size(item) > n) & (n > 0) & (F.slice(item, 1, n) == file)
    follows = F.element_at(item, F.least(n + 1, F.size(item)))
    return F.when(F.size(file) == 0, None).when(file == item, 3).when(joined, 2).when(prefix & ~is_sequel(follows), 1)


def fuzzy_join(files: DataFrame, items: DataFrame, header: int = 0, file: str = "file_id", group: str = "group_id", most: int = MOST_GROUPS) -> DataFrame:
    """Pairs of equal size (or size less a header) whose words signal each other, with at most ``most`` groups a file.

    The size goes with the first word into the key: every signal but "same
    letters" needs equal first words, and that one needs an equal first letter;
    so the join key is (size, first letter), which spreads repeated sizes.
    """
    sizes = F.array_distinct(F.array(F.col("size"), F.col("size") - F.lit(header))) if header else F.array(F.col("size"))
    letter = lambda w: F.substring(F.array_join(w, ""), 1, 1)
    probe = files.withColumn("_size", F.explode(sizes)).withColumn("_letter", letter(F.col("words")))
    side = items.select(*[F.col(c).alias(f"i_{c}") for c in items.columns], F.col("size").alias("_size"), letter(F.col("words")).alias("_letter"))
    pairs = probe.join(side, ["_size", "_letter"]).withColumn("signal", signal(F.col("words"), F.col("i_words"))).where("signal is not null")
    groups = F.size(F.collect_set(f"i_{group}").over(Window.partitionBy(file)))
    return pairs.withColumn("groups", groups).where(F.col("groups") <= most).drop("_size", "_letter")


def unique_words(files: DataFrame, source: str) -> DataFrame:
    """files with whether their words occur once in their source."""
    return files.withColumn("unique", F.count("*").over(Window.partitionBy(source, "words")) == 1)
