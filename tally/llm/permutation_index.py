"""Approximate nearest neighbours by a permutation index.

``PIVOTS`` vectors, drawn from 512 rows of least hash, are the pivots. Every vector is
represented by its ``PREFIX`` nearest pivots in order, and posted under each of
them. A query's vectors are ranked by the footrule distance between the two
orders (the sum of place differences; a pivot missing in one order counts as the
place after its last), those that come first are reranked by the exact distance,
and the ten nearest of each block are merged.

Index rows lie in blocks of about ``BLOCK`` by hash, queries in blocks of
``QUERIES``; each pair of a query block and an index block is one piece of work
of bounded size, so that no inverted file of the whole table is ever held. Pairs
are made by the tasks that read both tables of blocks, without shuffle or
broadcast, and a task sends on the nearest of all its blocks. Equal
vectors of a block are one entry with its least vec_ids, as many as a result can
hold: a vector that a third of all rows share can't crowd out others.

The index holds every row, with no caps. ``SHARE`` of a block's entries (and no
less than ``RERANK``) are reranked for each query; measured recall at 10 against
brute force is in the README.

Nothing is pruned before the ranking: on vectors without clusters, such as those of
the test tables, files of the nearest pivots alone miss too many neighbours. Work
grows with queries times rows; an index block is read once for each task of query blocks.

Defined results: vectors null, zero, or with null or non-finite components take no
part, nor do those of another length than most have (the longer one of two equally
common lengths); rows of the same vec_id are candidates of their own, each found once
(a query leaves out every row of its own vec_id), and query rows of one vec_id are one
query, whose distance to a row is the least of theirs; with fewer than ten candidates
all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import least, written

PIVOTS = 128
PREFIX = 64
BLOCK = 8192
QUERIES = 4096
SHARE = 0.2
RERANK = 200
NEAREST = 10
#: Files of a table of blocks, at most.
MOST_FILES = 10_000


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties to the lower pivot."""
    square = (vectors**2).sum(1)[:, None] - 2 * np.einsum("ij,kj->ik", vectors, pivots) + (pivots**2).sum(1)
    prefix = min(prefix, len(pivots))
    return np.argsort(square, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Block:
    """Distinct vectors of a block with their inverted files by pivot."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX, keep: int = NEAREST + 1):
        order = np.lexsort((rows, ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        self.rows = rows[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1)))
        self.entry = np.cumsum(new) - 1
        self.starts = np.append(np.flatnonzero(new), len(ids))
        self.ids, self.vectors, self.keep = ids, vectors[new], keep
        # entries in order of their least vec_id, so that ties in rank go to smaller ids
        self.prefix = min(prefix, len(pivots))
        order = orders(self.vectors.astype(float), pivots, prefix)
        place = np.tile(np.arange(self.prefix), len(order))
        row = np.repeat(np.arange(len(order)), self.prefix)
        by_pivot = np.argsort(order.reshape(-1), kind="stable")
        self.posted, self.places = row[by_pivot], place[by_pivot]
        self.cuts = np.searchsorted(order.reshape(-1)[by_pivot], np.arange(len(pivots) + 1))
        self.rerank = min(len(self.vectors), max(RERANK, int(SHARE * len(self.vectors))))

    def nearest(self, query_id: int, query: np.ndarray, order: np.ndarray, n: int = NEAREST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, row numbers and distances of the n nearest rows of the block by exact distance, among those ranked first."""
        footrule = np.zeros(len(self.vectors), np.int32)
        for at, pivot in enumerate(order.tolist()):
            s, e = self.cuts[pivot], self.cuts[pivot + 1]
            # against missing on both sides; the sum over all pivots differs by a constant
            footrule[self.posted[s:e]] += np.abs(self.places[s:e] - at) - (self.prefix - at) - (self.prefix - self.places[s:e])
        if self.rerank < len(footrule):
            chosen = np.argpartition(footrule, self.rerank - 1)[: self.rerank]
            chosen = np.flatnonzero(footrule <= footrule[chosen].max())
        else:
            chosen = np.arange(len(footrule))
        distance = np.sqrt(((self.vectors[chosen].astype(float) - query) ** 2).sum(1))
        if len(chosen) > n + 1:
            first = np.flatnonzero(distance <= np.partition(distance, n)[n])
            chosen, distance = chosen[first], distance[first]
        rows = [np.arange(self.starts[c], min(self.starts[c + 1], self.starts[c] + self.keep + self._own(c, query_id))) for c in chosen]
        distance = np.repeat(distance, list(map(len, rows)))
        rows = np.concatenate(rows) if rows else np.empty(0, np.int64)
        other = self.ids[rows] != query_id
        rows, distance = rows[other], distance[other]
        best = np.lexsort((self.rows[rows], self.ids[rows], distance))[:n]
        return self.ids[rows[best]], self.rows[rows[best]], distance[best]

    def _own(self, entry: int, query_id: int) -> int:
        """Rows of the query's own id among an entry, which do not count."""
        s, e = self.starts[entry], self.starts[entry + 1]
        return int(np.searchsorted(self.ids[s:e], query_id, "right") - np.searchsorted(self.ids[s:e], query_id, "left"))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles' source floats, of the rows that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).where(fine & F.col("vec_id").isNotNull())


PACKED = "block int, ids binary, rows binary, vectors binary"
FOUND = "query_id bigint, vec_id bigint, row bigint, score double"


def _pack(table: pa.Table) -> pa.Table:
    """Rows of one block as one row: ids, row numbers and vectors as bytes."""
    ids = table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = table.column("row").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.table({"block": table.column("block")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([rows.tobytes()], pa.binary()), "vectors": pa.array([flat.tobytes()], pa.binary())})


def _packed(rows: DataFrame, blocks: int, label: str) -> DataFrame:
    """Blocks as a table with a row each, in files of a few blocks, so that each is read by a task of its own or nearly so."""
    return written(rows.repartition(min(blocks, MOST_FILES), "block").groupBy("block").applyInArrow(_pack, PACKED), label)


def _merged(a: tuple, b: tuple, n: int) -> tuple:
    """The n nearest rows of two answers to one query vector from different blocks."""
    ids, rows, distance = (np.concatenate(pair) for pair in zip(a, b, strict=True))
    best = np.lexsort((rows, ids, distance))[:n]
    return ids[best], rows[best], distance[best]


def _search(pivots: np.ndarray, nearest: int):
    def run(batches):
        last, block, best = None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != last:
                    last = row["block"]
                    ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, pivots.shape[1])
                    block = Block(ids, np.frombuffer(row["rows"], np.int64), vectors, pivots, keep=nearest + 1)
                q_ids, queries = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"]).reshape(-1, pivots.shape[1])
                q_orders = orders(queries, pivots)
                found = [block.nearest(i, q, o, nearest) for i, q, o in zip(q_ids.tolist(), queries, q_orders, strict=True)]
                # a task sends the nearest of all its blocks
                before = best.get(row["q_block"], (q_ids, None))[1]
                best[row["q_block"]] = q_ids, found if before is None else [_merged(a, b, nearest) for a, b in zip(before, found, strict=True)]
        for q_ids, found in best.values():
            sizes = [len(f[0]) for f in found]
            if sum(sizes):
                columns = [np.repeat(q_ids, sizes), *(np.concatenate([f[k] for f in found]) for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "row", "score"])

    return run


def search(vectors: DataFrame, every: int = 100, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows of those whose vec_id is divisible by ``every``."""
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = usable(vectors)
    counts = F.count("*").alias("count"), F.count_if(F.col("vec_id") % every == 0).alias("asked")
    sizes = rows.groupBy(F.size("v").alias("width")).agg(*counts).orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], schema)
    width, n = sizes[0]["width"], sizes[0]["count"]
    # a number a row: candidates are rows, whatever their ids and vectors
    rows = written(rows.where(F.size("v") == width).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    picked = least(rows.select("vec_id", "v"), 4 * PIVOTS, n, "vec_id", "v").collect()  # a fixed number of pivots
    pivots = np.unique(np.array([r["v"] for r in picked]), axis=0)
    pivots = pivots[np.random.default_rng(1).permutation(len(pivots))[:PIVOTS]]
    blocks, q_blocks = -(-n // BLOCK), max(1, -(-sizes[0]["asked"] // QUERIES))
    packed = _packed(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")), blocks, "ann-blocks")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(q_blocks)).cast("int"))
    asked = _packed(asked, q_blocks, "ann-queries").select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # each query block meets each index block where it is read: nothing is copied to the driver or to disk for it
    work = packed.crossJoin(asked.hint("shuffle_replicate_nl"))
    found = written(work.select("block", "ids", "rows", "vectors", "q_block", "q_ids", "q_vectors").mapInArrow(_search(pivots, nearest), FOUND), "ann-found")
    # repeated query rows find the same rows: one answer, the nearest, for each query_id and found row
    once = found.groupBy("query_id", "row").agg(F.min("score").alias("score"), F.min("vec_id").alias("vec_id"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id", "row")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
