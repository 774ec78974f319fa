"""Language of texts by a linear-chain conditional random field over words.

A word's features are its affixes (up to three letters at either end), its
letter triples, and its entries in lexicons of frequent words, hashed
into ``DIMENSIONS`` weights a language; transitions between the languages of
neighbouring words are learned with them. Training sequences are stretches of
labelled documents, one to three of them joined, so that the transitions see
switches as code-switched text has them. Forward-backward gives every word's
posterior; a text's language is that of most of its letters, by posterior.

The field is fitted on the driver on ``FIT`` documents a language at most (those
of least hash among the rows with a language whose crc32(doc_id) mod 3 is not 1).
Each epoch draws its stretches anew from seeded places over the whole of these texts,
at most ``FIT_WORDS`` words a language.
The lexicons, ``LEXICON`` words a language, come from counts over all training
documents. Prediction is one Arrow pass over the whole texts; language, source
and doc_id are no inputs of it.

Defined results: null texts and texts without a letter are ``und`` with score 0;
rows of the same doc_id are predicted alone; without training rows every text
is ``und``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import written

FIT = 400
#: Words a language that an epoch is fitted on, at most.
FIT_WORDS = 96_000
#: Parts of a language's words that are ranked each alone before all are.
PARTS = 32
LEXICON = 300
BITS = 15
DIMENSIONS = 1 << BITS
MODULUS, HELD_OUT = 3, 1
STRETCH = 24
EPOCHS = 6
#: Words whose emissions a worker keeps; a full cache starts anew.
CACHE = 400_000
#: Words that go through the chain together.
GROUP = 200_000


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(filter(str.isalpha, word)).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of words of letters, word after word, and how many each has.

    On the UTF-8 bytes of <word>: all triples, and the pairs and quadruples at
    either end, which with the triples there are the affixes. An empty word has none.
    """
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" if w else b"" for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8).astype(np.uint64)
    start = np.cumsum(size) - size
    some = size > 0
    grams = {2: data[:-1] * 257 + data[1:] + (2 << 40)}
    grams[3] = grams[2][:-1] * 263 + data[2:]
    grams[4] = grams[3][:-1] * 269 + data[3:] + (4 << 50)
    triples = np.maximum(size - 2, 0)
    word = np.repeat(np.arange(len(raw)), triples)
    at = np.arange(len(word)) - np.repeat(np.cumsum(triples) - triples, triples) + start[word]
    where, code = [word], [grams[3][at]]
    for n in (2, 4):
        long = np.flatnonzero(some & (size >= n))
        where += [long, long]
        code += [grams[n][start[long]], grams[n][start[long] + size[long] - n] + 1]
    word, code = np.concatenate(where), np.concatenate(code)
    order = np.argsort(word, kind="stable")
    mixed = code[order] * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(word, minlength=len(raw))


def _times(a: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """a @ moves over the last axis, as sums over the few states."""
    out = a[..., :1] * moves[0]
    for k in range(1, len(moves)):
        out = out + a[..., k : k + 1] * moves[k]
    return out


def forward_backward(emissions: np.ndarray, sizes: np.ndarray, start: np.ndarray, moves: np.ndarray, block: int = 64) -> np.ndarray:
    """Posteriors of all positions of many chains (rows of emissions, chain after chain).

    Chains are cut into blocks that go side by side. A block's product of moves
    and emissions carries vectors over it, so that chains of any length take a
    step a block for what comes in from both ends, and the steps of one block
    for the rest. The result is that of the plain recursions.
    """
    n, states = len(emissions), len(moves)
    if not n:
        return np.empty((0, states))
    sizes = np.asarray(sizes)
    sizes = sizes[sizes > 0]
    blocks = -(-sizes // block)
    chain = np.repeat(np.arange(len(sizes)), blocks)
    head = np.cumsum(blocks) - blocks  # a chain's first block
    place = np.arange(len(chain)) - head[chain]
    length = np.minimum(block, sizes[chain] - place * block)
    at = ((np.cumsum(sizes) - sizes)[chain] + place * block)[:, None] + np.arange(block)
    live = np.arange(block) < length[:, None]
    e = np.exp(emissions - emissions.max(1, keepdims=True))[np.minimum(at, n - 1)]
    begins = place == 0
    full = int((length == block).all()) and block or int(length.min())  # up to here no block has ended
    carry = np.broadcast_to(np.eye(states), (len(chain), states, states)).copy()
    for t in range(block):
        step = _times(carry, moves)
        if t == 0:
            step[begins] = carry[begins]
        step *= e[:, t, None, :]
        if t >= full:
            step = np.where(live[:, t, None, None], step, carry)
        carry = step / step.sum((1, 2), keepdims=True) if t % 4 == 3 else step
    # vectors that come in from the left and from the right of each block
    left, right = np.empty((len(chain), states)), np.ones((len(chain), states))
    left[begins] = start
    order = np.argsort(-blocks, kind="stable")
    heads, counts = head[order], blocks[order]
    for j in range(1, int(counts[0])):
        b = heads[: np.searchsorted(-counts, -j, "left")] + j
        v = (left[b - 1][:, :, None] * carry[b - 1]).sum(1)
        left[b] = v / v.sum(1, keepdims=True)
    for j in range(int(counts[0]) - 1, 0, -1):
        b = heads[: np.searchsorted(-counts, -j, "left")] + j
        v = (carry[b] * right[b][:, None, :]).sum(2)
        right[b - 1] = v / v.sum(1, keepdims=True)
    alpha, now = np.empty_like(e), left
    for t in range(block):
        step = _times(now, moves)
        if t == 0:
            step[begins] = now[begins]
        step = step * e[:, t]
        now = step / step.sum(1, keepdims=True)
        alpha[:, t] = now
    now, back = right, moves.T
    for t in range(block - 1, -1, -1):
        alpha[:, t] *= now
        step = _times(e[:, t] * now, back)
        step /= step.sum(1, keepdims=True)
        now = np.where(live[:, t, None], step, now) if t >= full else step
    out = alpha[live]
    return out / out.sum(1, keepdims=True)


class Model:
    """Weights of features and moves, and the emission cache of a worker."""

    def __init__(self, langs: list[str], lexicon: dict[str, int], weights: np.ndarray, start: np.ndarray, moves: np.ndarray):
        self.langs, self.lexicon, self.weights, self.start, self.moves = langs, lexicon, weights, start, moves

    def open(self) -> Model:
        self.cache: dict[bytes, int] = {}
        self.table = np.empty((0, len(self.langs) + 1))
        return self

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emissions of words of letters in each language."""
        code, size = features(words)
        word = np.repeat(np.arange(len(words)), size)
        out = np.stack([np.bincount(word, self.weights[code, c], len(words)) for c in range(len(self.langs))], axis=1)
        for k, w in enumerate(words):
            if mask := self.lexicon.get(w):
                out[k] += sum(self.weights[DIMENSIONS + c] for c in range(mask.bit_length()) if mask >> c & 1)
        return out

    def look(self, words: list[bytes]) -> np.ndarray:
        """Emissions, and in the last column the number of letters, of each word."""
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > CACHE:
                self.open()
                found = [None] * len(words)
            new = list(dict.fromkeys(w for w, k in zip(words, found, strict=True) if k is None))
            plain = [letters(w.decode("utf-8", "replace")) for w in new]
            size = np.fromiter(map(len, plain), float, len(plain))
            rows = np.concatenate((self.emissions(plain), size[:, None]), axis=1)
            self.cache.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate((self.table, rows))
            found = list(map(self.cache.__getitem__, words))
        return self.table[np.array(found, np.int64)]

    def label(self, text: bytes | None) -> list[str]:
        """The language of each word of a text: the one of the highest posterior."""
        words = text.split() if text else []
        if not words:
            return []
        posterior = forward_backward(self.look(words)[:, :-1], np.array([len(words)]), self.start, self.moves)
        return [self.langs[k] for k in posterior.argmax(1).tolist()]

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        """(language, share of its letters) of each text."""
        words = [text.split() if text else [] for text in texts]
        sizes = np.array(list(map(len, words)))
        rows = self.look([w for text in words for w in text])
        weight = rows[:, -1]
        posterior = forward_backward(rows[:, :-1], sizes, self.start, self.moves)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        share = np.stack([np.bincount(doc, weight * posterior[:, k], len(sizes)) for k in range(len(self.langs))], axis=1)
        total = share.sum(1)
        return [(self.langs[int(s.argmax())], float(min(1.0, s.max() / t))) if t > 0 else ("und", 0.0) for s, t in zip(share, total, strict=True)]


def _stretches(texts: list[list[str]], langs: np.ndarray, rng: np.random.Generator) -> list[tuple[list[str], np.ndarray]]:
    """Sequences of one to three stretches of the texts with the languages of their words."""
    places: dict[int, list[tuple[int, int]]] = {}
    for k, words in enumerate(texts):
        shift = int(rng.integers(STRETCH)) if len(words) > STRETCH else 0
        places.setdefault(int(langs[k]), []).extend((k, max(0, i)) for i in range(-shift, len(words), STRETCH))
    parts = []
    for lang in sorted(places):
        rng.shuffle(places[lang])
        parts += places[lang][: FIT_WORDS // STRETCH]
    rng.shuffle(parts)
    out, at = [], 0
    while at < len(parts):
        n = int(rng.choice((1, 1, 2, 3)))
        words, labels = [], []
        for k, i in parts[at : at + n]:
            piece = texts[k][i : i + int(rng.integers(STRETCH // 3, STRETCH + 1))]
            words += piece
            labels += [langs[k]] * len(piece)
        at += n
        if words:
            out.append((words, np.array(labels)))
    return out


def train(texts: list[str], labels: list[str], lexicon: dict[str, int], langs: list[str], seed: int = 7) -> Model:
    """AdaGrad on the log-likelihood, gradients by forward-backward."""
    rng, n = np.random.default_rng(seed), len(langs)
    weights, moves, start = np.zeros((DIMENSIONS + n, n)), np.eye(n) * 2.0, np.zeros(n)
    seen_w, seen_m, seen_s = np.full(weights.shape, 1e-6), np.full(moves.shape, 1e-2), np.full(n, 1e-2)
    n_langs, y = n, np.array([langs.index(x) for x in labels])
    words = [[letters(w) for w in t.split()] for t in texts]
    vocabulary = sorted({w for text in words for w in text})
    codes, size = features(vocabulary)
    ends = np.cumsum(size)
    known = {w: codes[e - n : e].tolist() + [DIMENSIONS + c for c in range(n_langs) if lexicon.get(w, 0) >> c & 1] for w, n, e in zip(vocabulary, size.tolist(), ends.tolist(), strict=True)}
    for _ in range(EPOCHS):
        sequences = _stretches(words, y, rng)
        for k in range(0, len(sequences), 64):
            batch = sequences[k : k + 64]
            at = [known[w] for s, _ in batch for w in s]
            flat = np.fromiter((f for a in at for f in a), np.int64)
            row = np.repeat(np.arange(len(at)), [len(a) for a in at])
            sizes = np.array([len(s) for s, _ in batch])
            gold = np.concatenate([g for _, g in batch])
            emissions = np.stack([np.bincount(row, weights[flat, c], len(at)) for c in range(n)], axis=1)
            m, s = np.exp(moves - moves.max()), np.exp(start - start.max())
            post, pairs = _expectations(emissions, sizes, s, m)
            firsts = np.cumsum(sizes) - sizes
            gap = post.copy()
            gap[np.arange(len(gold)), gold] -= 1
            used, back = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(back, gap[row, c], len(used)) for c in range(n)], axis=1) / len(batch)
            seen_w[used] += grad**2
            weights[used] -= 0.15 * grad / np.sqrt(seen_w[used])
            inner = np.ones(len(gold), bool)
            inner[firsts] = False
            to = np.flatnonzero(inner)
            real = np.bincount(gold[to - 1] * n + gold[to], minlength=n * n).reshape(n, n)
            grad = (pairs - real) / len(batch)
            seen_m += grad**2
            moves -= 0.1 * grad / np.sqrt(seen_m)
            grad = (post[firsts].sum(0) - np.bincount(gold[firsts], minlength=n)) / len(batch)
            seen_s += grad**2
            start -= 0.1 * grad / np.sqrt(seen_s)
    return Model(langs, lexicon, weights, np.exp(start - start.max()), np.exp(moves - moves.max()))


def _expectations(emissions: np.ndarray, sizes: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of positions, and expected counts of moves, for short chains."""
    n, longest = len(sizes), int(sizes.max())
    first = np.cumsum(sizes) - sizes
    where = np.minimum(first[:, None] + np.arange(longest), len(emissions) - 1)
    live = np.arange(longest) < sizes[:, None]
    e = np.exp(emissions - emissions.max(1, keepdims=True))[where]
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(longest):
        a = e[:, t] * (start if t == 0 else np.einsum("ij,jk->ik", alpha[:, t - 1], moves))
        alpha[:, t] = a / a.sum(1, keepdims=True)
    pairs = np.zeros_like(moves)
    for t in range(longest - 2, -1, -1):
        on = live[:, t + 1]
        step = e[:, t + 1] * beta[:, t + 1]
        b = np.einsum("ij,kj->ik", step, moves)
        beta[:, t] = np.where(on[:, None], b / b.sum(1, keepdims=True), 1.0)
        both = alpha[on, t][:, :, None] * moves * step[on][:, None, :]
        pairs += (both / both.sum((1, 2), keepdims=True)).sum(0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    return post[live], pairs


def _word_counts(batches):
    """(lang, word, n) of the words of letters, summed up to some hundred thousand words at a time."""
    counts: dict[str, Counter] = {}

    def flush():
        sums: Counter = Counter()
        for lang, words in counts.items():
            for word, n in words.items():
                if plain := letters(word.decode("utf-8", "replace")):
                    sums[lang, plain] += n
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        texts = batch.column("text")
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            counts.setdefault(lang, Counter()).update(texts[i].as_py().lower().split())
            if i % 64 == 0 and sum(map(len, counts.values())) > CACHE:
                yield flush()
    yield flush()


def fit(docs: DataFrame) -> Model | None:
    """The field learned from docs (doc_id, text, lang); None without a labelled row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(key) % MODULUS != HELD_OUT)).select("doc_id", "text", "lang")
    counts = rows.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(_word_counts, "lang string, word string, n bigint")
    counts = written(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "crf-words")
    # words below the power of two that LEXICON words of a language reach can't be among them: few rows a language are ranked
    level = F.floor(F.log2("n")).cast("int")
    reach = Window.partitionBy("lang").orderBy(F.desc("level"))
    levels = counts.groupBy("lang", level.alias("level")).agg(F.count("*").alias("k")).withColumn("above", F.sum("k").over(reach) - F.col("k"))
    bounds = levels.where(F.col("above") < LEXICON).groupBy("lang").agg(F.min("level").alias("least"))
    counts = counts.join(bounds, "lang").where(level >= F.col("least")).drop("least")
    # ranked in parts first: what a language's own ranking reads does not grow with words or partitions
    part = F.pmod(F.xxhash64("word"), F.lit(PARTS))
    best = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "word")
    # dealt by both: left to itself, Spark deals by the language once for both rankings
    counts = counts.withColumn("part", part).repartition("lang", "part").withColumn("k", F.row_number().over(best)).where(F.col("k") <= LEXICON).drop("k", "part")
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    frequent = counts.withColumn("k", F.row_number().over(top)).where(F.col("k") <= LEXICON).collect()  # LEXICON words a language
    langs = sorted({r["lang"] for r in frequent})
    if not langs:
        return None
    lexicon: dict[str, int] = {}
    for r in frequent:
        lexicon[r["word"]] = lexicon.get(r["word"], 0) | 1 << langs.index(r["lang"])
    keys = written(rows.select("lang", "doc_id", F.xxhash64("text").alias("h")).distinct(), "crf-keys")
    # rows far above the hash that the FIT least of a language lie under are not ranked, if enough lie under it
    sizes = keys.groupBy("lang").agg(F.count("*").alias("all"))
    under = (F.xxhash64("doc_id").cast("double") + 2.0**63) * F.col("all") < 2.0**64 * 8 * FIT
    few = keys.join(sizes, "lang").where(under)
    short = sizes.join(few.groupBy("lang").agg(F.count("*").alias("got")), "lang", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.col("all"), F.lit(FIT)))
    keys = keys if not short.isEmpty() else few.drop("all")
    least = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    chosen = written(keys.withColumn("k", F.row_number().over(least)).where(F.col("k") <= FIT).select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "crf-fit")
    rows = rows.withColumn("h", F.xxhash64("text"))
    same = (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    sample = rows.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["lang", "doc_id", "h"]).orderBy("lang", "doc_id", "h").collect()
    return train([r["text"] for r in sample], [r["lang"] for r in sample], lexicon, langs)


def _predict(model: Model | None):
    def run(batches):
        if model is not None:
            model.open()
        for batch in batches:
            texts, n = batch.column("text"), batch.num_rows
            found, held, words = [], [], 0
            for i in range(n):
                held.append(texts[i].as_py())
                words += len(held[-1] or b"") // 5
                if words >= GROUP or i == n - 1:
                    found += model.predict(held) if model is not None else [("und", 0.0)] * len(held)
                    held, words = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _label(model: Model | None):
    def run(batches):
        if model is not None:
            model.open()
        for batch in batches:
            texts = batch.column("text")
            found = [model.label(texts[i].as_py()) if model is not None else ["und"] * len((texts[i].as_py() or b"").split()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "langs"])

    return run


def label_words(docs: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """doc_id and langs, the language of each word in order, of every row of docs; the field is learned from ``fitted``, or docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_label(fit(docs if fitted is None else fitted)), "doc_id bigint, langs array<string>")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    model = fit(docs)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(key) % MODULUS == HELD_OUT).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id bigint, held_out boolean, lang_pred string, score double")
