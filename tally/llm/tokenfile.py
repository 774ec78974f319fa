"""Token-id files: whole texts as ids, Re-Pair compressed, in doc_id order.

A shard holds the ids of consecutive documents, about ``SHARD`` ids (a document
is never cut). Re-Pair replaces frequent neighbouring pairs by new symbols until no
pair occurs ``MIN_COUNT`` times. It goes in rounds: a round counts all pairs of the
shard, takes up to ``BATCH`` of the most frequent ones in which every symbol is a left
or a right one alone (so that no two chosen occurrences overlap; a pair of one symbol
with itself is counted and replaced left to right), and replaces all their occurrences
at once.
What a round leaves out is counted again in the next. The payload of a shard is

    magic "TRP1", then little-endian u32: base, width (bytes a symbol), rules,
    symbols, ids; then the rules (left, right), their expansion lengths (u32)
    and the symbols

and prefix sums of the expansion lengths find any id without decoding the rest.
Shards are rows (shard, doc_ids, starts, payload) of a Parquet table, so that
any store that Spark reaches can hold them.

Defined results: null and empty texts hold the end id alone; documents are in
order of doc_id, null first, then of a hash of their text (rows that agree in
both are alike); an empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bpe import encoder
from ._common import goes_at_exit, new_path, shuffles_go

MAGIC = b"TRP1"
END = 2
SHARD = 1 << 20
MIN_COUNT = 8
#: Symbols replaced in one round, at most.
BATCH = 3000


def _overlapping(seq: np.ndarray) -> np.ndarray:
    """Places of pairs of one symbol with itself that overlap an earlier one of their run, taken left to right."""
    same = np.flatnonzero(seq[:-1] == seq[1:])
    if not len(same):
        return same
    first = np.concatenate(([True], np.diff(same) > 1))
    start = np.maximum.accumulate(np.where(first, same, 0))
    return same[(same - start) % 2 == 1]


def _apart(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Places, in order, of pairs (a, b), most frequent first, in which every symbol is a left or a right one alone, or both in a pair with itself.

    A symbol takes the side that it has in its first pair; pairs that agree with that are
    chosen, and the sides of their symbols stay while the others are gone through again.
    """
    left, right = np.zeros(size, bool), np.zeros(size, bool)
    chosen, rest = np.zeros(len(a), bool), np.arange(len(a))
    as_left, as_right = np.empty(size, np.int64), np.empty(size, np.int64)
    for _ in range(4):
        x, y = a[rest], b[rest]
        may = ~right[x] & ~left[y] & ((x != y) | ~left[x] & ~right[x])
        rest, x, y = rest[may], x[may], y[may]
        if not len(rest):
            break
        as_left[x] = as_right[x] = as_left[y] = as_right[y] = len(a)
        as_left[x[::-1]], as_right[y[::-1]] = rest[::-1], rest[::-1]
        as_left[left] = as_right[right] = -1  # sides that are taken come first
        own = (x == y) & (as_left[x] == rest) & (as_right[x] == rest)
        fits = own | (x != y) & (as_left[x] < as_right[x]) & (as_right[y] < as_left[y])
        chosen[rest[fits]] = True
        left[x[fits]] = right[y[fits]] = True
        rest = rest[~fits]
    return np.flatnonzero(chosen)


def compress(ids: np.ndarray, base: int, min_count: int = MIN_COUNT) -> bytes:
    """The payload of one shard; ids are below base. Goes on until no pair occurs min_count times."""
    seq, rules, shift = ids.astype(np.uint32), [], 16 if base <= 1 << 16 else 32
    while len(seq) > 1:
        if shift == 16 and base + len(rules) + BATCH > 1 << 16:
            shift = 32
        kind = np.uint32 if shift == 16 else np.uint64
        mask, seq = kind((1 << shift) - 1), seq.astype(kind)
        codes = (seq[:-1] << kind(shift)) | seq[1:]
        overlap = _overlapping(seq)
        ordered = np.delete(codes, overlap) if len(overlap) else codes.copy()
        ordered.sort()
        m = min_count - 1
        if len(ordered) <= m:
            break
        # of runs of min_count and more alone: where they start, and where they end
        edge = np.ones(len(ordered) + 1, bool)
        np.not_equal(ordered[1:], ordered[:-1], out=edge[1:-1])
        long = ordered[m:] == ordered[: len(ordered) - m]
        starts = np.flatnonzero(long & edge[: len(long)])
        if not len(starts):
            break
        pairs, counts = ordered[starts], np.flatnonzero(long & edge[m + 1 :]) + min_count - starts
        if len(pairs) > 4 * BATCH:
            top = np.argpartition(-counts, 4 * BATCH)[: 4 * BATCH]
            pairs, counts = pairs[top], counts[top]
        pairs = pairs[np.lexsort((pairs, -counts))]
        chosen = np.sort(pairs[_apart((pairs >> kind(shift)).astype(np.int64), (pairs & mask).astype(np.int64), base + len(rules))][:BATCH])
        # bit 1 of a symbol: left of a chosen pair, bit 2: right; each symbol of the text is looked up once
        side = np.zeros(base + len(rules), np.uint8)
        side[(chosen >> kind(shift)).astype(np.int64)] |= 1
        side[(chosen & mask).astype(np.int64)] |= 2
        sides = side.take(seq)
        may = (sides[:-1] & (sides[1:] >> 1)).view(bool)
        may[overlap] = False
        maybe = np.flatnonzero(may)
        at = np.searchsorted(chosen, codes[maybe])
        at[at == len(chosen)] = 0
        hit = chosen[at] == codes[maybe]
        where = maybe[hit]
        seq = seq.astype(np.uint32)
        seq[where] = (base + len(rules) + at[hit]).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        seq = seq[keep]
        rules.extend(zip((chosen >> kind(shift)).tolist(), (chosen & mask).tolist(), strict=True))
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = np.dtype(f"<u{width}")
    lengths = expansions(np.array(rules, np.int64).reshape(-1, 2), base)
    head = struct.pack("<5I", base, width, len(rules), len(seq), len(ids))
    return MAGIC + head + np.array(rules, kind).reshape(-1, 2).tobytes() + lengths.astype("<u4").tobytes() + seq.astype(kind).tobytes()


def expansions(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule's symbol stands for."""
    out = np.ones(base + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[base + k] = out[a] + out[b]
    return out[base:]


class Shard:
    """A payload, opened; ids(start, end) decodes that range alone."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.base, width, n_rules, n_seq, self.n_ids = struct.unpack_from("<5I", payload, 4)
        kind, at = np.dtype(f"<u{width}"), 24
        rules = np.frombuffer(payload, kind, 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 2 * n_rules * width
        lengths = np.frombuffer(payload, "<u4", n_rules, at).astype(np.int64)
        self.seq = np.frombuffer(payload, kind, n_seq, at + 4 * n_rules)
        self.lengths = np.concatenate((np.ones(self.base, np.int64), lengths))
        # all symbols written out one after another: terminals, then rules in order
        self.place = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.empty(self.place[-1], "<u4")
        self.flat[: self.base] = np.arange(self.base)
        # rules whose symbols all stand before a run of rules are written together
        newest, start = rules.max(1, initial=0) - self.base, 0
        while start < n_rules:
            later = np.flatnonzero(newest[start:] >= start)
            end = start + int(later[0]) if len(later) else n_rules
            first = self.place[self.base + start]
            self.flat[first : self.place[self.base + end]] = self._written(rules[start:end].reshape(-1))
            start = end
        self.ends = np.cumsum(self.lengths[self.seq])

    def _written(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of symbols whose expansions are written out."""
        lengths = self.lengths[symbols]
        shift = self.place[symbols] - np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return self.flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Little-endian u32 ids from start to end."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if end <= start:
            return np.empty(0, "<u4")
        first, last = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, end, "left")
        part = self.seq[first : last + 1]
        skip = start - (self.ends[first] - self.lengths[part[0]])
        return self._written(part)[skip : skip + end - start]


SHARDS = "part int, shard int, doc_ids array<bigint>, starts array<bigint>, n_ids bigint, payload binary"


def _write_shards(path: str | None, end: int, shard_ids: int):
    def run(batches):
        from pyspark import TaskContext

        words, part, shard = encoder(path, "<u2"), TaskContext.get().partitionId(), 0
        kind = "<u2" if words.size < 1 << 16 else "<u4"
        if kind != "<u2":
            words = encoder(path, kind)
        tail = np.array([end], kind).tobytes()
        doc_ids, starts, parts, n = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(parts), kind)
            row = {"part": [part], "shard": [shard], "doc_ids": [doc_ids], "starts": [starts], "n_ids": [n], "payload": [compress(ids, max(words.size, end + 1))]}
            return pa.RecordBatch.from_arrays(
                [pa.array(row["part"], pa.int32()), pa.array(row["shard"], pa.int32()), pa.array(row["doc_ids"], pa.list_(pa.int64())), pa.array(row["starts"], pa.list_(pa.int64())), pa.array(row["n_ids"], pa.int64()), pa.array(row["payload"], pa.binary())],
                names=list(row),
            )

        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = words.encode(texts[i].as_py()) + tail
                doc_ids.append(doc_id)
                starts.append(n)
                parts.append(ids)
                n += len(ids) // encoder_width(kind)
                if n >= shard_ids:
                    yield flush()
                    doc_ids, starts, parts, n, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield flush()

    return run


def encoder_width(kind: str) -> int:
    return np.dtype(kind).itemsize


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = END, shard_ids: int = SHARD) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order into shards at path."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    with shuffles_go(docs.sparkSession):
        ordered.select("doc_id", "text").mapInArrow(_write_shards(vocabulary, end, shard_ids), SHARDS).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)


def _digest(batches):
    for batch in batches:
        out = {"part": [], "shard": [], "doc_id": [], "at": [], "n_tokens": [], "ids_crc32": []}
        for row in batch.to_pylist():
            ids = Shard(row["payload"]).ids()
            ends = [*row["starts"][1:], row["n_ids"]]
            raw = memoryview(ids.tobytes())
            for doc_id, s, e in zip(row["doc_ids"], row["starts"], ends, strict=True):
                out["doc_id"].append(doc_id)
                out["at"].append(s)
                out["n_tokens"].append(e - s)
                out["ids_crc32"].append(zlib.crc32(raw[4 * s : 4 * e]))
            out["part"] += [row["part"]] * len(ends)
            out["shard"] += [row["shard"]] * len(ends)
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files.

    Shards of a part are added up in a window of that part, and parts (one a writing
    task) in a window of one row a part: nothing goes to the driver.
    """
    shards = read_token_files(spark, path)
    listed = shards.select("part", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = listed.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("begin"))
    begins = listed.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("inside")).join(parts, "part")
    begins = begins.select("part", "shard", (F.col("begin") + F.col("inside")).alias("first"))
    rows = shards.mapInArrow(_digest, "part int, shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(begins, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_table(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Write docs as token files in the shared folder and return their digest."""
    path = new_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, end)
    goes_at_exit(docs.sparkSession, path)
    return digest(docs.sparkSession, path)
