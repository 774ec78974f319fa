"""Quality classifier from weak labels.

Nine heuristic labellers vote good, bad or nothing on every document. The votes
of a document are one pattern; the counts of all patterns over all documents (at
most 3**9 rows) hold all that expectation-maximisation needs to estimate how
often each labeller votes what on good and on bad documents, and from these the
posterior of every pattern. Posteriors label a bounded sample of rows (``FIT``
documents, those of least hash), on which a linear scorer over hashed word
shapes and vote statistics is trained by logistic regression. The scorer then
scores every document; at 0.5 and above a document is good.

Defined results: a null or empty text has no words, and only the labeller of
length votes (bad); rows of the same doc_id are scored alone, each by its text;
an empty table gives an empty result. Given labels are never read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import least, written
from .quality_rules import SYMBOLS, repeated_words

#: Rows on which the scorer is trained, at most.
FIT = 6000
DIMENSIONS = 1 << 12
EPOCHS = 30
#: (measure, bad above or None, good at or below or None): the thresholds of the labellers.
LABELLERS = (
    ("symbols_per_word", 0.4, 0.05),
    ("upper_words", 0.35, 0.1),
    ("duplicate_lines", 0.4, 0.05),
    ("repeated_words", 0.5, 0.1),
    ("marked_words", 0.3, 0.05),
    ("bare_symbols", 0.1, 0.01),
    ("odd_word_length", 0.5, 0.15),
    ("shortness", 0.25, 0.02),
    ("stutter", 0.3, 0.05),
)
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_MARKED = re.compile(rb"[^\w\s\x80-\xff]{2,}$")
CACHE = 400_000


class Shapes(dict):
    """word -> feature number of its shape; a full cache starts anew."""

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_SHAPE))
        n = self[word] = (zlib.crc32(shape) % DIMENSIONS) * 8 + (4 if _MARKED.search(word) else 0) + (2 if word.isupper() and len(word) > 1 else 0) + (1 if not any(65 <= b <= 122 or b > 127 or 48 <= b <= 57 for b in word) else 0)
        return n


def measures(text: bytes | None, shapes: Shapes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The measures of the labellers, and the shape features with their shares of the words."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return np.array([0, 0, 0, 0, 0, 0, 0, 1.0, 0]), np.empty(0, np.int64), np.empty(0)
    codes, counts = np.unique(np.fromiter(map(shapes.__getitem__, words), np.int64, n), return_counts=True)
    share = counts / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    found = np.array([
        (len(text) - len(text.translate(None, SYMBOLS))) / n,
        share[(codes & 2) > 0].sum(),
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        repeated_words(words) / n,
        share[(codes & 4) > 0].sum(),
        share[(codes & 1) > 0].sum(),
        ((sizes < 2) | (sizes > 25)).mean(),
        2 / (n + 1),
        sum(map(bytes.__eq__, words, words[1:])) / n,
    ])
    features, at = np.unique(codes >> 3, return_inverse=True)
    return found, features, np.bincount(at, share)


def vote(found: np.ndarray) -> int:
    """All votes as one number: base 3 digits, 0 nothing, 1 bad, 2 good."""
    pattern = 0
    for k, (_, bad, good) in enumerate(LABELLERS):
        x = found[k]
        pattern += 3**k * (1 if x > bad else 2 if x <= good else 0)
    return pattern


def _digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of good for each pattern by expectation-maximisation from a majority start.

    Only votes count: a labeller that says nothing says nothing about the class.
    """
    votes = _digits(patterns)
    good = (((votes == 2).sum(1) + 1.0) / ((votes > 0).sum(1) + 2.0)).clip(0.05, 0.95)
    # one clear bad vote outweighs several weak good ones at the start
    good = np.where((votes == 1).any(1), np.minimum(good, 0.4), good)
    for _ in range(rounds):
        log_odds = np.zeros(len(patterns))
        weight = counts * good, counts * (1 - good)
        prior = (weight[0].sum() + 1) / (counts.sum() + 2)
        for k in range(votes.shape[1]):
            for v in (1, 2):
                chance = [(w[votes[:, k] == v].sum() + 1) / (w[votes[:, k] > 0].sum() + 2) for w in weight]
                log_odds[votes[:, k] == v] += np.log(chance[0] / chance[1])
        after = 1 / (1 + np.exp(-(log_odds + np.log(prior / (1 - prior))).clip(-30, 30)))
        if np.abs(after - good).max() < 1e-6:
            break
        good = after
    return good


def _dense(found: np.ndarray) -> np.ndarray:
    """Small dense inputs of the scorer beside the shapes: the measures, and whether each is beyond its threshold."""
    bad = np.array([x[1] for x in LABELLERS])
    return np.concatenate((np.minimum(found / bad, 3.0), found > bad))


MEASURED = "doc_id bigint, h bigint, pattern int, found array<double>, features array<int>, shares array<float>"


def _measure(batches):
    shapes = Shapes()
    for batch in batches:
        texts = batch.column("text")
        patterns, founds, features, shares = [], [], [], []
        for i in range(batch.num_rows):
            found, feature, share = measures(texts[i].as_py(), shapes)
            patterns.append(vote(found))
            founds.append(found)
            features.append(feature)
            shares.append(share)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(patterns, pa.int32()), pa.array(founds, pa.list_(pa.float64())), pa.array(features, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
            names=["doc_id", "h", "pattern", "found", "features", "shares"],
        )


def measure(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(_measure, MEASURED), "weak")


def train(rows: list, posterior: dict[int, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the shapes, of the dense inputs, and the bias, by AdaGrad on soft labels."""
    shapes, dense, bias = np.zeros(DIMENSIONS), np.zeros(2 * len(LABELLERS)), 0.0
    if not rows:
        return shapes, dense, bias
    sizes = np.array([len(r["features"]) for r in rows])
    at = np.concatenate([np.array(r["features"], np.int64) for r in rows])
    share = np.sqrt(np.concatenate([np.array(r["shares"], float) for r in rows]))
    row = np.repeat(np.arange(len(rows)), sizes)
    x = np.array([_dense(np.array(r["found"])) for r in rows])
    y = np.array([posterior[r["pattern"]] for r in rows])
    weight = np.where(y > 0.5, 0.5 / max(1.0, (y > 0.5).sum()), 0.5 / max(1.0, (y <= 0.5).sum()))  # both classes count alike
    weight = weight / weight.sum() * len(rows)
    seen_s, seen_d, seen_b = np.full(DIMENSIONS, 1e-8), np.full(len(dense), 1e-8), 1e-8
    for _ in range(EPOCHS * 5):
        z = np.bincount(row, shapes[at] * share, len(rows)) + (x * dense).sum(1) + bias
        gap = weight * (1 / (1 + np.exp(-z.clip(-30, 30))) - y) / len(rows)
        g_s = np.bincount(at, gap[row] * share, DIMENSIONS) + 1e-5 * shapes
        g_d, g_b = (x * gap[:, None]).sum(0) + 1e-5 * dense, gap.sum()
        seen_s, seen_d, seen_b = seen_s + g_s**2, seen_d + g_d**2, seen_b + g_b**2
        shapes -= 0.3 * g_s / np.sqrt(seen_s)
        dense -= 0.3 * g_d / np.sqrt(seen_d)
        bias -= 0.3 * g_b / np.sqrt(seen_b)
    return shapes, dense, float(bias)


def fit(measured: DataFrame) -> tuple[dict[int, float], tuple]:
    counts = measured.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3**9 rows at most
    patterns = np.array([r["pattern"] for r in counts], np.int64)
    posterior = dict(zip(patterns.tolist(), estimate(patterns, np.array([r["n"] for r in counts], float)).tolist(), strict=True)) if counts else {}
    rows = least(measured, FIT, sum(r["n"] for r in counts), "doc_id", "h").collect()
    return posterior, train(rows, posterior)


def _score(posterior: dict[int, float], model: tuple):
    shapes, dense, bias = model

    def run(batches):
        for batch in batches:
            scores = []
            for found, features, shares in zip(batch.column("found").to_pylist(), batch.column("features").to_pylist(), batch.column("shares").to_pylist(), strict=True):
                z = (_dense(np.array(found)) * dense).sum() + bias + (shapes[features] * np.sqrt(shares)).sum() if features else (_dense(np.array(found)) * dense).sum() + bias
                scores.append(float(1 / (1 + np.exp(-min(30.0, max(-30.0, z))))))
            weak = [posterior[p] for p in batch.column("pattern").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(weak, pa.float64()), pa.array(scores, pa.float64())], names=["doc_id", "h", "weak_label", "score"])

    return run


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), weak_label (posterior of the votes), score, kept of every row."""
    measured = measure(docs)
    posterior, model = fit(measured)
    scored = measured.select("doc_id", "h", "pattern", "found", "features", "shares").mapInArrow(_score(posterior, model), "doc_id bigint, h bigint, weak_label double, score double")
    return scored.withColumn("kept", F.col("score") >= 0.5)


def _filter(posterior: dict[int, float], model: tuple):
    score = _score(posterior, model)

    def run(batches):
        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), batch.column("text").cast(pa.binary())], names=["doc_id", "h", "text"])
            (scored,) = score(_measure([rows]))
            yield batch.filter(pa.compute.greater_equal(scored.column("score"), 0.5))

    return run


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps, in one pass after the fit."""
    import pyarrow.compute  # noqa: F401

    posterior, model = fit(measure(docs))
    return docs.mapInArrow(_filter(_Rest(posterior), model), docs.schema)


class _Rest(dict):
    """Posteriors by pattern; a pattern that the fit has not seen says nothing."""

    def __missing__(self, key):
        return 0.5
