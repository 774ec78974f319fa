"""Language-model scores of whole texts by deleted interpolation.

P1(w) = a * c(w)/N + (1 - a) / (V + 1) and P(w | h) = b * c(h w)/c(h) + (1 - b) P1(w),
with one weight b for each bucket of context frequency, floor(log2 c(h)). Some
training documents are held out of the counts at first; expectation-maximisation
on the tokens of these learns a and every b. The scores use the counts of all
training documents. Counts are exact, over all documents, but for words and word
pairs that agree in 64-bit hashes.

Texts become chunks of about ``CHUNK`` tokens, a row each: local word numbers,
and the hashes of the chunk's words. A chunk asks for its distinct words and
pairs once, with its own counts, as sorted hashes in buckets of the hash range;
a bucket adds up what all chunks send and answers each in the order it asked, so
that answers hold counts alone. Frequent words cost one entry a chunk, buckets
are even by hash, and their number follows the tokens. Weights come from
histograms of probability ratios, which are additive: EM on them is EM on all
held-out tokens, at a resolution of a sixteenth of a power of two.

Defined results: a null or empty text is the end token alone; a null doc_id
counts as the empty text in the choice of training documents; rows of the same
doc_id are documents of their own; an empty table gives an empty result; without
training documents every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bucket_count, written, written_by

CHUNK = 1 << 18
#: Entries that a bucket should get, and the least number of buckets.
BUCKET = 1 << 20
LEAST_BUCKETS = 128
MODULUS, HELD_OUT, DEVELOPMENT = 7, 2, 3
#: Histogram of log2 ratios: from -32 to 32 by sixteenths; bin 0 holds ratio zero.
BINS = 1025
#: The end of a document, which is also the context of its first word.
END_HASH = xxhash.xxh64_intdigest(b" end")
_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def remainder(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % MODULUS


def _planes(x: np.ndarray) -> bytes:
    """Bytes of x by place, high zeros together: what block compression likes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _packed(x: np.ndarray) -> bytes:
    """Counts as planes of as many bytes as the largest needs, their number first."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + _planes(x.astype("<u8"))[: width * len(x)]


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k in range(width):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


def _rows(batch):
    """Rows of a batch one at a time: a chunk is some MB."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _values(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


CHUNKS = "chunk bigint, doc_ids array<bigint>, parts array<tinyint>, sizes array<int>, words binary, tokens binary"


def _chunks(batches):
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32

    def flush():
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) if w else END_HASH for w in numbers), np.uint64, len(numbers))
        columns = ([chunk], [doc_ids], [parts], [list(map(len, tokens))], [hashes.tobytes()], [np.concatenate(tokens).tobytes()])
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    numbers, doc_ids, parts, tokens, n = _Numbers({b"": 0}), [], [], [], 0
    for batch in batches:
        texts = batch.column("text")
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            words = (texts[i].as_py() or b"").lower().split()
            ids = np.zeros(len(words) + 1, np.uint32)
            ids[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            doc_ids.append(doc_id)
            parts.append(remainder(doc_id))
            tokens.append(ids)
            n += len(ids)
            if n >= CHUNK:
                yield flush()
                numbers, doc_ids, parts, tokens, n, chunk = _Numbers({b"": 0}), [], [], [], 0, chunk + 1
    if doc_ids:
        yield flush()


class Chunk:
    """A chunk's tokens, and its distinct words and pairs in the order of their hashes."""

    def __init__(self, row: dict):
        self.doc_ids, self.parts = row["doc_ids"], np.array(row["parts"], np.int8)
        self.sizes = np.array(row["sizes"], np.int64)
        hashes, self.tokens = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], np.uint32)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.part = self.parts[self.doc]
        # words in order of hash: place[token] is a token's entry
        order = np.argsort(hashes)
        place = np.empty(len(hashes), np.int64)
        place[order] = np.arange(len(hashes))
        self.words = hashes[order]
        self.word = place[self.tokens]
        self.context = np.concatenate(([0], self.word[:-1]))
        self.context[np.cumsum(self.sizes)[:-1]] = place[0]
        self.context[:1] = place[0]
        code = self.context * len(hashes) + self.word
        pairs, self.pair = np.unique(code, return_inverse=True)
        first, second = np.divmod(pairs, len(hashes))
        mixed = (self.words[first] ^ (self.words[first] >> _FOLD)) * _MIX + self.words[second]
        mixed = (mixed ^ (mixed >> _FOLD)) * _MIX
        mixed ^= mixed >> np.uint64(32)
        order = np.argsort(mixed)
        place = np.empty(len(pairs), np.int64)
        place[order] = np.arange(len(pairs))
        self.pairs, self.pair = mixed[order], place[self.pair]

    def asks(self):
        """(order, sorted hashes, counts in the counted part, counts in the development part)."""
        counted, held = (self.part != HELD_OUT) & (self.part != DEVELOPMENT), self.part == DEVELOPMENT
        for order, keys, at in ((1, self.words, self.word), (2, self.pairs, self.pair)):
            yield order, keys, *(np.bincount(at[m], minlength=len(keys)).astype(np.uint32) for m in (counted, held))


ASKS = "order int, bucket bigint, chunk bigint, keys binary, counted binary, held binary"


def _asks(bits: int):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                out = {"order": [], "bucket": [], "chunk": [], "keys": [], "counted": [], "held": []}
                for order, keys, counted, held in Chunk(row).asks():
                    # a piece for each bucket that has an entry: the keys are in order
                    top = keys >> np.uint64(64 - bits)
                    cuts = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1], [True])))
                    for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        out["order"].append(order)
                        out["bucket"].append(int(top[s]))
                        out["chunk"].append(row["chunk"])
                        out["keys"].append(_planes(np.diff(keys[s:e], prepend=np.uint64(0))))
                        out["counted"].append(_packed(counted[s:e]))
                        out["held"].append(_packed(held[s:e]))
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=list(out))

    return run


ANSWERS = "order int, bucket bigint, chunk bigint, counted binary, trained binary, distinct_counted bigint, distinct_trained bigint, n_counted bigint, n_trained bigint, seen array<bigint>, unseen bigint"


def _answer(table: pa.Table) -> pa.Table:
    """All that is asked of one bucket: sums by hash, sent back in the order of each ask."""
    rows = table.to_pylist()
    keys = [np.cumsum(_values(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    sizes = np.cumsum([len(k) for k in keys])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    counted = np.bincount(at, np.concatenate([_unpacked(r["counted"]) for r in rows])).astype(np.int64)
    held = np.bincount(at, np.concatenate([_unpacked(r["held"]) for r in rows])).astype(np.int64)
    trained = counted + held
    # held-out tokens by the log2 of their word's count, for the weight of single words
    levels = np.zeros(BINS, np.int64)
    known = counted > 0
    np.add.at(levels, np.rint(16 * np.log2(counted[known])).astype(np.int64), held[known])
    out = {n.split()[0]: [] for n in ANSWERS.split(", ")}
    for k, r in enumerate(rows):
        mine = at[sizes[k] - len(keys[k]) : sizes[k]]
        head = k == 0
        for name, value in (
            ("order", r["order"]), ("bucket", r["bucket"]), ("chunk", r["chunk"]), ("counted", _packed(counted[mine])), ("trained", _packed(trained[mine])),
            ("distinct_counted", int(known.sum()) * head), ("distinct_trained", int((trained > 0).sum()) * head), ("n_counted", int(counted.sum()) * head), ("n_trained", int(trained.sum()) * head),
            ("seen", levels.tolist() if head and r["order"] == 1 else None), ("unseen", int(held[~known].sum()) * head),
        ):
            out[name].append(value)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64())
    return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def mixture_weight(ratios: np.ndarray, counts: np.ndarray, rounds: int = 300) -> float:
    """Weight of the first of two distributions by EM, from held-out counts by probability ratio."""
    if not counts.sum():
        return 0.0
    weight = 0.5
    for _ in range(rounds):
        after = float((counts * weight * ratios / (weight * ratios + 1 - weight)).sum() / counts.sum())
        if abs(after - weight) < 1e-9:
            break
        weight = after
    return min(max(weight, 1e-6), 1 - 1e-6)


class Counts:
    """Answers of a chunk, lined up with its entries: counts of each token's word, context and pair."""

    def __init__(self, chunk: Chunk, answers: list[dict], kind: str):
        answers = sorted(answers, key=lambda a: a["bucket"])
        one, two = (np.concatenate([_unpacked(a[kind]) for a in answers if a["order"] == order]).astype(float) for order in (1, 2))
        self.word, self.context, self.pair = one[chunk.word], one[chunk.context], two[chunk.pair]

    def parts(self, n: float, v: float, a: float):
        """P1, the pair's estimate, and the bucket of each token's context (0: never seen)."""
        p1 = a * self.word / max(n, 1) + (1 - a) / (v + 1)
        seen = self.context > 0
        ml = np.divide(self.pair, self.context, out=np.zeros(len(self.pair)), where=seen)
        bucket = np.where(seen, np.floor(np.log2(np.maximum(self.context, 1))).astype(np.int64) + 1, 0)
        return p1, ml, bucket


def _development(n: float, v: float, a: float):
    def run(batches):
        for batch in batches:
            out = []
            for row in _rows(batch):
                chunk = Chunk(row)
                held = chunk.part == DEVELOPMENT
                if not held.any():
                    continue
                p1, ml, bucket = (x[held] for x in Counts(chunk, row["answers"], "counted").parts(n, v, a))
                level = np.zeros(len(p1), np.int64)
                some = ml > 0
                level[some] = np.clip(np.rint(16 * np.log2(ml[some] / p1[some])) + 513, 1, BINS - 1).astype(np.int64)
                out.append(np.bincount(bucket * BINS + level, minlength=64 * BINS))
            total = np.sum(out, axis=0) if out else np.zeros(64 * BINS, np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _scores(n: int, v: int, a: float, b: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                chunk = Chunk(row)
                counts = Counts(chunk, row["answers"], "trained")
                p1, ml, bucket = counts.parts(n, v, a)
                p = b[bucket] * ml + (1 - b[bucket]) * p1
                docs = len(chunk.sizes)
                add = lambda x: np.bincount(chunk.doc, x, docs)  # noqa: B023, E731
                columns = (
                    pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.parts == HELD_OUT), pa.array(chunk.sizes), pa.array(add(counts.word > 0).astype(np.int64)),
                    pa.array(np.full(docs, n, np.int64)), pa.array(add(np.log10((counts.word + 1) / (n + 1 * (v + 1))))), pa.array(add(np.log10(p))),
                )
                yield pa.RecordBatch.from_arrays(list(columns), names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n = bucket_count(rows)
    # a file for each chunk at most: chunks are the rows, and each is some MB
    chunks = written_by(rows.mapInArrow(_chunks, CHUNKS), "lm-chunks", "chunk", n)
    tokens = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    bits = max(LEAST_BUCKETS, tokens // BUCKET).bit_length() - 1
    asks = chunks.mapInArrow(_asks(bits), ASKS)
    # tasks follow the buckets, a few each, however many shuffle partitions are set
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (2 << bits) // 4)
    answers = written(asks.repartition(tasks, "order", "bucket").groupBy("order", "bucket").applyInArrow(_answer, ANSWERS), "lm-answers")
    words = answers.where(F.col("order") == 1)
    totals = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("distinct_counted", "distinct_trained", "n_counted", "n_trained", "unseen")]).first()
    levels = np.zeros(BINS)
    for r in words.where("seen is not null").select(F.posexplode("seen").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():  # BINS rows at most
        levels[r["level"]] = r["n"]
    v, tokens = totals["distinct_counted"], totals["n_counted"]
    ratios = np.append(2.0 ** (np.arange(BINS) / 16) * (v + 1) / max(tokens, 1), 0.0)
    a = mixture_weight(ratios, np.append(levels, totals["unseen"]))
    mine = answers.groupBy("chunk").agg(F.collect_list(F.struct("order", "bucket", "counted", "trained")).alias("answers"))
    joined = chunks.join(written_by(mine, "lm-mine", "chunk", n), "chunk")  # both in buckets of the chunk: no shuffle
    cells = joined.mapInArrow(_development(tokens, v, a), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # 64 * BINS rows at most
    held = np.zeros(64 * BINS)
    for r in cells:
        held[r["cell"]] = r["n"]
    ratios = np.append(0.0, 2.0 ** ((np.arange(1, BINS) - 513) / 16))
    b = np.array([mixture_weight(ratios, held[k * BINS : (k + 1) * BINS]) if k else 0.0 for k in range(64)])
    return joined.mapInArrow(_scores(totals["n_trained"], totals["distinct_trained"], a, b), SCORES)
