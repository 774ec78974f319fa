"""Connected components of a graph given by its edges, on DataFrame functions alone.

Alternating stars: the large star links the larger neighbours of a node to the
smallest one, the small star its smaller ones, until the edges are stars around
the smallest node of each component: every node has one smaller neighbour, which
has none. Every round is two tables in the shared folder, whose rows say whether
either did not hold. Minima are pre-aggregated, and the joins back to the edges are plain
equi-joins whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_table, written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of any one orderable type -> (node, root): every node that has an edge, and the least node of its component."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    stars = False
    for _ in range(ROUNDS):
        # u > v in every edge: the least of v and its neighbours is the least of v and its smaller ones
        least = now.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "v")
        large = now.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v"), F.col("m").isNotNull().alias("moved")).distinct()
        large = written(large, "edges")
        if stars and large.where("moved").isEmpty():
            drop_table(large)
            break
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("more"))
        after = written(small.unionByName(least.select("u", F.col("m").alias("v"), F.lit(False).alias("more"))).distinct(), "edges")
        drop_table(large)
        drop_table(now)
        now, stars = after, after.where("more").isEmpty()
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
