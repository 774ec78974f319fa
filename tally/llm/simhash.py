"""SimHash near-duplicates of documents by a binary trie self-join.

A document's fingerprint has a bit where over half of its shingles' XXH64 have
it. Fingerprints of at most ``BUDGET`` differing bits are linked; documents of
equal or linked fingerprints, directly or over others, are one component.

The self-join works on distinct fingerprints. Five blocks of bits of which at most
four can differ leave one that agrees, so every link falls into a group of
fingerprints that share a block; from more fingerprints on, groups share two of six
blocks, or three of seven (``BLOCKS``), which keeps a group some hundreds large and
finds the same links. In a group, the fingerprints in order are the leaves of a binary
trie. Pairs of nodes go down together, level by
level, with the bits in which they differ so far, and end where these exceed the
budget. Pairs of nodes that lie in one component already end as well, so a group
of near copies costs about its size and not its square, and gives a spanning
forest and not all its pairs. No link is lost: what is cut off joins nothing new.

``drop_near_duplicates`` with a similarity also links texts of at least that
shingle Jaccard similarity. Fingerprints cannot find these (at 0.8 about ten bits
differ), so candidates are texts that agree in one of ``BANDS`` bands of ``ROWS``
minimal shingle hashes: a pair of similarity j is missed with probability
(1 - j^ROWS)^BANDS, 0.00003 at 0.8. Every candidate is decided by its whole shingle
sets, so no pair below the similarity is linked by this. A band first links its
texts to one of them; only texts still in different components are compared in pairs.

Defined results: a text without words, or null, has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle; rows of the
same doc_id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import block_masks, signed, written
from .graph import components

SHINGLE = 4
SEED = 42
BUDGET = 4
#: (fingerprints up to which, blocks that agree): 5 keys of 13 bits, 15 of 21, 35 of 27.
BLOCKS = ((1 << 22, 1), (1 << 31, 2), (1 << 62, 3))
#: Pairs of leaves below which two trie nodes are compared directly.
LEAF = 16
#: Node pairs taken from the stack at a time.
SLICE = 1 << 18
#: Rows that a task gathers before it joins the groups among them.
GATHER = 1 << 17
#: Bands of minimal shingle hashes, and hashes a band.
BANDS, ROWS = 20, 4
_LANES = np.uint64(0x0101010101010101)
_MINIMA = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's shingles; none without words."""
    words = text.lower().split() if text else []
    parts = {b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of the minimal hashes of a set of shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(found), 4096):
        least = np.minimum(least, (found[k : k + 4096, None] * _MINIMA[0] + _MINIMA[1]).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ least[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros((8, 8), np.int64), len(starts)
    for k in range(0, n, 1 << 16):
        s, e = starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist()
        h = np.array([digest(line[a:b], SEED) for a, b in zip(s, e, strict=True)], np.uint64)
        # eight counters of a byte in each word; sums of 255 rows do not overflow
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, np.arange(0, len(h), 255))
            total[:, bit] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = (total * 2 > n).reshape(64)  # byte by byte, low bit first
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = np.fromiter((fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(found.view(np.int64))], names=["doc_id", "h", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h (a hash of the text) and fp (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id bigint, h bigint, fp bigint")


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of i and j in labels, which name the least row of each."""
    while len(i):
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def trie_join(group: np.ndarray, fps: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Labels of the rows' components in their groups; rows in order of (group, fp), distinct in both."""
    n = len(fps)
    labels = np.arange(n)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    s, e = edges[:-1], edges[1:]
    big = e - s > 1
    s, e = s[big], e[big]
    stack = [(0, s, e, s, e, np.zeros(len(s), np.int8))]
    ones = np.empty(n + 1, np.int64)
    cached, mixed = -1, None
    while stack:
        depth, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > SLICE:
            stack.append((depth, *(x[SLICE:] for x in (a0, a1, b0, b1, diff))))
            a0, a1, b0, b1, diff = (x[:SLICE] for x in (a0, a1, b0, b1, diff))
        if mixed is None:
            mixed = np.concatenate(([0, 0], np.cumsum(labels[1:] != labels[:-1])))
        # both nodes wholly in one component: nothing new below
        done = (labels[a0] == labels[b0]) & (mixed[a1] == mixed[a0 + 1]) & (mixed[b1] == mixed[b0 + 1])
        a0, a1, b0, b1, diff = (x[~done] for x in (a0, a1, b0, b1, diff))
        if not len(a0):
            continue
        work = (a1 - a0) * (b1 - b0)
        leaf = (work <= LEAF) | (depth == 64)
        if leaf.any():
            w, x0, y0, wide = work[leaf], a0[leaf], b0[leaf], (b1 - b0)[leaf]
            k = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            wide = np.repeat(wide, w)
            i, j = np.repeat(x0, w) + k // wide, np.repeat(y0, w) + k % wide
            up = i < j
            i, j = i[up], j[up]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            if near.any():
                _unite(labels, i[near], j[near])
                mixed = None
            a0, a1, b0, b1, diff = (x[~leaf] for x in (a0, a1, b0, b1, diff))
            if not len(a0):
                continue
        if cached != depth:
            ones[0], cached = 0, depth
            np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1), out=ones[1:])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same, more = a0 == b0, (diff + 1).astype(np.int8)
        other = ~same
        kids = (
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, more),
            *((x[other] for x in side) for side in ((am, a1, b0, bm, more),)),
        )
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*map(tuple, kids), strict=True))
        live = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 < 2))
        stack.append((depth + 1, *(x[live] for x in (a0, a1, b0, b1, diff))))
    return labels


def _join_groups(batches):
    """Rows (key, fp) in order of key -> edges (u, v) of a spanning forest of each group's links."""

    def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        labels = trie_join(key, fp)
        at = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[labels[at]].view(np.int64))], names=["u", "v"])

    keys, fps, n = [], [], 0
    for batch in batches:
        if batch.num_rows:
            keys.append(batch.column("key").to_numpy())
            fps.append(batch.column("fp").to_numpy().view(np.uint64))
            n += batch.num_rows
        if n >= GATHER and keys[0][0] != keys[-1][-1]:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = int(np.searchsorted(key, key[-1], "left"))
            yield edges(key[:cut], fp[:cut])
            keys, fps, n = [key[cut:]], [fp[cut:]], n - cut
    if n:
        yield edges(np.concatenate(keys), np.concatenate(fps))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): a spanning forest, in each group, of the links between distinct fingerprints (column fp)."""
    n = fps.count()
    masks = block_masks(BUDGET, next(agree for most, agree in BLOCKS if n <= most))
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(signed(m))) for k, m in enumerate(masks)])
    keyed = fps.select(F.explode(keys).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_join_groups, "u bigint, v bigint")


def classify(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, h, fp and component_id, the least doc_id of its component, of every row."""
    marked = written(fingerprints(docs, shingle), "simhash")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = written(components(links(fps)), "simhash-roots").select(F.col("node").alias("fp"), "root")
    firsts = roots.join(fps, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(firsts, "root").select("fp", "component_id")
    known = written(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-known")
    return marked.join(known, "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classify(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _sketches(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            fps, sizes, keys = [], [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                found = shingles(text, shingle)
                fps.append(fingerprint(text, shingle))
                sizes.append(len(found))
                keys.append(bands(found).view(np.int64) if len(found) else np.empty(0, np.int64))
            columns = [batch.column("doc_id"), batch.column("h"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "fp", "size", "keys"])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = [shingles(texts[i].as_py(), shingle).view(np.int64) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array(found, pa.list_(pa.int64()))], names=["h", "found"])

    return run


def _similar(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The fingerprints (u, v) of those pairs of texts (a, b) whose shingle sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).distinct()
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text")).join(wanted, "h", "left_semi").dropDuplicates(["h"])
    sets = written(texts.mapInArrow(_sets(shingle), "h bigint, found array<bigint>"), "simhash-sets")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("found").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - 1e-9).select("u", "v").distinct()


def _classify_similar(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """As classify, with texts of similar shingle sets linked, too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    marked = written(rows.mapInArrow(_sketches(shingle), "doc_id bigint, h bigint, fp bigint, size bigint, keys array<bigint>"), "simhash")
    fps = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    texts = marked.where("size > 0").dropDuplicates(["h"])
    by_key = Window.partitionBy("key")
    keyed = texts.select(F.explode("keys").alias("key"), "h", "fp", "size")
    # another text of a group in every band, so that one that is far from most of them does no harm
    centre = F.min(F.struct(F.xxhash64("key", "h").alias("rank"), "h", "fp", "size")).over(by_key)
    shared = keyed.select("*", F.count("*").over(by_key).alias("n"), centre.alias("centre")).where("n > 1")
    shared = written(shared.select("key", "h", "fp", "size", F.col("centre.h").alias("c_h"), F.col("centre.fp").alias("c_fp"), F.col("centre.size").alias("c_size")), "simhash-bands")
    near = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9
    first = shared.where((F.col("fp") != F.col("c_fp")) & near("size", "c_size")).select(F.col("h").alias("a"), F.col("c_h").alias("b"), F.col("fp").alias("u"), F.col("c_fp").alias("v")).distinct()
    found = links(fps).unionByName(_similar(written(first, "simhash-pairs"), docs, shingle, similarity))
    roots = written(components(written(found, "simhash-links")), "simhash-roots")
    known = shared.join(roots, shared["fp"] == roots["node"], "left").select("key", "h", "fp", "size", F.coalesce("root", "fp").alias("root"))
    a, b = (known.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("h", "fp", "size", "root")]) for side in "ab")
    rest = a.join(b, (a["key"] == b["key"]) & (F.col("a_root") < F.col("b_root")) & near("a_size", "b_size"))
    rest = written(rest.select(F.col("a_h").alias("a"), F.col("b_h").alias("b"), F.col("a_fp").alias("u"), F.col("b_fp").alias("v")).distinct(), "simhash-pairs")
    if not rest.isEmpty():
        more = _similar(rest, docs, shingle, similarity).unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = written(components(more), "simhash-roots")
    roots = roots.select(F.col("node").alias("fp"), "root")
    firsts = roots.join(fps, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(firsts, "root").select("fp", "component_id")
    known = written(fps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "simhash-known")
    return marked.select("doc_id", "h", "fp").join(known, "fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """docs without near duplicates: of each component the row of least (doc_id, hash of text) stays.

    similarity: also link texts of at least this Jaccard similarity of shingles.
    """
    found = classify(docs, shingle) if similarity is None else _classify_similar(docs, shingle, similarity)
    keep = found.groupBy("component_id").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("keep_id"), F.col("k.h").alias("keep_h"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64("text").alias("h"))
    held = rows.join(keep, F.col("doc.doc_id").eqNullSafe(F.col("keep_id")) & (F.col("h") == F.col("keep_h")), "left_semi")
    return held.select("doc", "h", F.col("doc.doc_id").alias("id")).dropDuplicates(["id", "h"]).select("doc.*")
