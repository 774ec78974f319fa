"""Packing documents into training sequences by cutting-stock column generation.

A document of L ids gives L // size full sequences and a rest of L % size ids.
Rests are counted in length classes of ``STEP`` ids (256 classes at 2048, for
any number of documents). The linear program over patterns (how many rests of
each class share a sequence) that covers these counts with the fewest sequences
is solved by column generation: a revised simplex method keeps one column a
class, and a knapsack dynamic program over the duals prices the next one.
Columns are used as often as the whole part of their value; what that leaves (a
few rests for each class, whatever the input) is packed first-fit decreasing
and becomes patterns, too. The rests of a class, ranked by chunk and place in
it, go to the pattern slots of that class in order.

Only the class counts come to the driver. Ranks are exact and need no task that
sees a whole class: a rank is the place in a chunk of documents plus the count
of the class in earlier chunks.

Defined results: null and empty texts hold the end id alone; rows of the same
doc_id are packed as documents of their own; an empty table gives no pieces.
Sequence ids are dense: sequences of rests count from 0, full ones follow in order
of chunk.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._common import written

SIZE = 2048
STEP = 8
END = 1
#: Documents in a chunk, the unit of ranking.
CHUNK = 20_000


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of classes 1..capacity (weight = class) for value[class - 1]."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        with_class = value[:w] + best[w - 1 :: -1][:w]
        c = int(with_class.argmax())
        if with_class[c] > best[w - 1] + 1e-12:
            best[w], last[w] = with_class[c], c + 1
        else:
            best[w] = best[w - 1]
    pattern, w = np.zeros(capacity, np.int64), capacity
    while w > 0:
        if last[w] == 0:
            w -= 1
        else:
            pattern[last[w] - 1] += 1
            w -= last[w]
    return float(best[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; plain numpy, since BLAS threads may not outlive the fork that starts Spark."""
    n = len(matrix)
    work = np.concatenate((matrix.astype(float), np.eye(n)), axis=1)
    for k in range(n):
        top = k + int(np.abs(work[k:, k]).argmax())
        if top != k:
            work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        rest = work[:, k].copy()
        rest[k] = 0
        rows = np.flatnonzero(rest)
        work[rows] -= rest[rows, None] * work[k]
    return work[:, n:].copy()


def column_generation(demand: np.ndarray, most: int = 5000) -> list[tuple[np.ndarray, float]]:
    """(pattern, uses) pairs of an optimal basis of the covering program; demand[class - 1] rests of each class.

    Ends when no pattern prices out. A basis that is not optimal after ``most`` turns still covers the
    demand and is used with a warning: it costs padding, no documents.
    """
    capacity, rows = len(demand), np.flatnonzero(demand)
    if not len(rows):
        return []
    d = demand[rows].astype(float)
    basis = np.diag((capacity // (rows + 1)).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), d / np.diag(basis)
    cost = np.ones(len(rows))
    value = np.zeros(capacity)
    for turn in range(1, most + 1):
        duals = np.einsum("i,ij->j", cost, inverse)
        worst = int(duals.argmin())
        if duals[worst] < -1e-9:  # cover more than is asked for
            column, price = np.zeros(len(rows)), 0.0
            column[worst] = -1
        else:
            value[:] = 0
            value[rows] = np.maximum(duals, 0)
            gain, pattern = knapsack(value, capacity)
            if gain <= 1 + 1e-7:
                break
            column, price = pattern[rows].astype(float), 1.0
        step = np.einsum("ij,j->i", inverse, column)
        able = step > 1e-9
        if not able.any():
            break
        ratio = np.where(able, x / np.where(able, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out], cost[out] = column, price
        if turn % 100:
            pivot = inverse[out] / step[out]
            inverse -= np.outer(step, pivot)
            inverse[out] = pivot
        else:
            inverse = _inverse(basis)
            x = np.maximum(np.einsum("ij,j->i", inverse, d), 0)
    else:
        warnings.warn(f"no optimal basis after {most} turns", stacklevel=2)
    found = []
    for k in np.flatnonzero((cost > 0) & (x > 1e-9)):
        pattern = np.zeros(capacity, np.int64)
        pattern[rows] = np.rint(basis[:, k]).astype(np.int64)
        found.append((pattern, float(x[k])))
    return found


def plan_patterns(demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(pattern, sequences) pairs that hold every rest: rounded columns, then first-fit decreasing."""
    capacity, left, plan = len(demand), demand.astype(np.int64).copy(), []
    for pattern, uses in column_generation(demand):
        n = int(uses + 1e-6)
        if n:
            plan.append((pattern, n))
            left -= n * pattern
    left = np.maximum(left, 0)
    bins: dict[bytes, int] = {}
    while left.any():
        free, pattern = capacity, np.zeros(capacity, np.int64)
        for c in np.flatnonzero(left)[::-1]:
            if c + 1 <= free:
                n = min(int(left[c]), free // int(c + 1))
                pattern[c] += n
                free -= n * int(c + 1)
        n = int(min(left[c] // pattern[c] for c in np.flatnonzero(pattern)))
        left -= n * pattern
        bins[pattern.tobytes()] = bins.get(pattern.tobytes(), 0) + n
    return plan + [(np.frombuffer(k, np.int64), n) for k, n in bins.items()]


def _slots(plan: list[tuple[np.ndarray, int]], capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first ranks, rests a sequence, first sequence and first slot of its runs."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken, sequence = np.zeros(capacity, np.int64), 0
    for pattern, n in plan:
        slot = 0
        for c in np.flatnonzero(pattern)[::-1].tolist():
            a = int(pattern[c])
            runs.setdefault(c + 1, []).append((int(taken[c]), a, sequence, slot))
            taken[c] += a * n
            slot += a
        sequence += n
    return {c: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for c, r in runs.items()}


LENGTHS = "doc_id bigint, doc_tokens bigint, chunk bigint, class int, place bigint, full bigint, crcs array<bigint>, ids binary"


def _measure(path: str | None, end: int, size: int, step: int, chunk: int, keep_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        encode, tail = encoder(path).encode, np.array([end], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId() << 32, 0
        places, fulls = np.zeros(size // step + 2, np.int64), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                if seen == chunk:
                    part, seen, fulls = part + 1, 0, 0
                    places[:] = 0
                raw = encode(texts[i].as_py()) + tail
                n = len(raw) // 4
                rest = n % size
                kind = -(-rest // step)
                out[0].append(doc_id)
                out[1].append(n)
                out[2].append(part)
                out[3].append(kind)
                out[4].append(int(places[kind]))
                out[5].append(fulls)
                out[6].append([zlib.crc32(raw[k : k + 4 * size]) for k in range(0, len(raw), 4 * size)])
                out[7].append(raw if keep_ids else None)
                places[kind] += 1
                fulls += n // size
                seen += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["doc_id", "doc_tokens", "chunk", "class", "place", "full", "crcs", "ids"])

    return run


def _assign(slots: dict[int, tuple[np.ndarray, ...]]):
    """Sequence and slot of each rest from its class and rank."""

    def run(batches):
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for c in np.unique(kind).tolist():
                at = np.flatnonzero(kind == c)
                starts, each, first, place = slots[c]
                k = np.searchsorted(starts, rank[at], "right") - 1
                j = rank[at] - starts[k]
                sequence[at], slot[at] = first[k] + j // each[k], place[k] + j % each[k]
            names = [n for n in batch.schema.names if n not in ("class", "rank")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(slot)], names=[*names, "sequence_id", "slot"])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, end: int = END, step: int = STEP, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with keep_ids)."""
    measured = written(docs.select("doc_id", "text").mapInArrow(_measure(vocabulary, end, size, step, CHUNK, keep_ids), LENGTHS), "pack-lengths")
    counts = written(measured.where("class > 0").groupBy("chunk", "class").agg(F.count("*").alias("n")), "pack-counts")
    demand = np.zeros(-(-size // step), np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # a row a class: 256 at most
        demand[r["class"] - 1] = r["n"]
    plan = plan_patterns(demand)
    slots, rest_sequences = _slots(plan, len(demand)), sum(n for _, n in plan)
    # a row a chunk: how many full sequences the earlier ones hold
    fulls = measured.groupBy("chunk").agg(F.sum(F.floor(F.col("doc_tokens") / size)).alias("n"))
    before_chunk = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    fulls = fulls.select("chunk", F.coalesce(F.sum("n").over(before_chunk), F.lit(0)).alias("earlier"))
    earlier = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("chunk", "class", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    part = lambda start: [F.substring("ids", (4 * start + 1).cast("int"), F.lit(4 * size)).alias("ids")] if keep_ids else []
    tail = F.col("doc_tokens") % size
    rests = measured.where("class > 0").join(firsts, ["chunk", "class"]).select(
        "doc_id", (F.col("doc_tokens") - tail).alias("start"), tail.alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens",
        *part(F.col("doc_tokens") - tail), "class", (F.col("first") + F.col("place")).alias("rank"),
    )
    plain = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint," + (" ids binary," if keep_ids else "")
    placed = rests.mapInArrow(_assign(slots), plain + " sequence_id bigint, slot bigint")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])]
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(names)
    whole = measured.where(F.col("doc_tokens") >= size).join(fulls, "chunk").select("*", F.posexplode(F.slice("crcs", 1, (F.col("doc_tokens") / size).cast("int"))).alias("k", "crc")).select(
        "doc_id", (F.col("k") * F.lit(size).cast("long")).alias("start"), F.lit(size).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.lit(rest_sequences) + F.col("earlier") + F.col("full") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *part(F.col("k") * size),
    )
    return placed.unionByName(whole.select(names))
