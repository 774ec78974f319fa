"""Cases that a cut would lose: near copies, long texts, repeated rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tally.llm import language_crf, line_dedup, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def invented(rng, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(n)]


def jaccard(a: str, b: str, k: int = 5) -> float:
    x, y = ({tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


# pipeline, near duplicates -------------------------------------------------------


@pytest.fixture(scope="module")
def near_copies():
    """Texts with a copy each, of similarity 0.8 to 0.95 (even pairs) or 0.5 to 0.75 (odd ones)."""
    rng, out = random.Random(3), []
    while len(out) < 120:
        words = invented(rng, rng.choice((60, 200, 400)))
        other = list(words)
        for k in rng.sample(range(len(words)), max(1, int(len(words) * rng.uniform(0.002, 0.08)))):
            other[k] = invented(rng, 1)[0]
        a, b = " ".join(words), " ".join(other)
        low, high = ((0.8, 0.96), (0.5, 0.75))[len(out) % 2]
        if low <= jaccard(a, b) <= high:
            out.append((a, b))
    return out


def test_pipeline_drops_near_copies_from_080(spark, near_copies):
    rows = [(2 * k + side, t, "en", "s", len(t)) for k, pair in enumerate(near_copies) for side, t in enumerate(pair)]
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS).repartition(3), "").collect()}
    assert kept >= set(range(0, 240, 2))
    assert kept - set(range(0, 240, 2)) == {2 * k + 1 for k in range(120) if k % 2}


def test_chain_and_hot_group_of_near_copies(spark):
    """A large group of near copies, similar to their source and each other, leaves one."""
    rng = random.Random(8)
    words, rows = invented(rng, 200), []
    for k in range(150):
        other = list(words)
        other[rng.randrange(200)] = f"new{k}"
        rows.append((k, " ".join(other), "en", "s", 1))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "one two", "en", "s", 7), (903, "One  two", "en", "s", 8)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.drop_near_duplicates(docs, 5, 0.8)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 900, 902}
    assert simhash.drop_near_duplicates(docs.where("doc_id < 0"), 5, 0.8).count() == 0


# op4 ---------------------------------------------------------------------------


def test_line_dedup_finds_near_copies_of_any_length(spark):
    """One word in five replaced, one word lost or added, and misspelt words: of each pair the first line stays."""
    rng, pairs = random.Random(11), []
    for n in (5, 6, 7, 8, 9, 10, 12, 15, 16, 19, 20, 21, 24, 30, 50, 90):
        for _ in range(4):
            words = invented(rng, n)
            other = list(words)
            for k in rng.sample(range(n), n // 5):
                other[k] = invented(rng, 1)[0]
            pairs.append((words, other))
            words, k = invented(rng, n), rng.randrange(n)
            pairs.append((words, [*words[:k], "added", *words[k:]]))
            if n > 5:
                words, k = invented(rng, n), rng.randrange(n)
                pairs.append((words, [*words[:k], *words[k + 1 :]]))
    words = invented(rng, 8)
    pairs.append((words, [w + "x" if k in (1, 2) else w for k, w in enumerate(words)]))
    words = invented(rng, 30)
    pairs.append((words, [w + "x" if k in range(20, 27) else w for k, w in enumerate(words)]))
    far = [" ".join(invented(rng, n)) for n in (5, 8, 20, 40) for _ in range(5)]
    far += [" ".join([*x.split()[: len(x.split()) // 2], *invented(rng, len(x.split()) // 2)]) for x in far]
    texts = [" ".join(x) for pair in pairs for x in pair] + far
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS), counts=True, runs=True).collect()}
    assert got == {k: int(k < 2 * len(pairs) and k % 2) for k in range(len(rows))}


def test_line_dedup_of_one_word(spark):
    """Without runs: lines of up to 32 words that differ in one word, replaced, added or lost, are found whatever the word."""
    rng, texts = random.Random(12), []
    for n in (5, 6, 9, 15, 16, 17, 24, 31):
        for _ in range(3):
            words, k = invented(rng, n), rng.randrange(n)
            texts += [" ".join(words), " ".join([*words[:k], "extraordinarily" * 2, *words[k + 1 :]])]
            words, k = invented(rng, n), rng.randrange(n)
            texts += [" ".join(words), " ".join([*words[:k], "added", *words[k:]])]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS), counts=True).collect()}
    assert got == {k: k % 2 for k in range(len(rows))}


# op6 ---------------------------------------------------------------------------


def test_training_reads_whole_texts():
    texts = [[f"w{k}" for k in range(20_000)], [f"x{k}" for k in range(300)], ["one"], []]
    rng, seen = np.random.default_rng(1), set()
    for _ in range(language_crf.EPOCHS):
        for words, labels in language_crf._stretches(texts, np.array([0, 1, 1, 1]), rng):
            assert len(words) == len(labels) and all((w[0] == "w") == (y == 0) for w, y in zip(words, labels, strict=True))
            seen.update(words)
    assert len(seen & set(texts[0])) >= 19_000 and len(seen & set(texts[1])) >= 280 and "one" in seen


def test_training_is_bounded_by_words_a_language(monkeypatch):
    monkeypatch.setattr(language_crf, "FIT_WORDS", 2400)
    found = language_crf._stretches([["a"] * 20_000, ["b"] * 100], np.array([0, 1]), np.random.default_rng(1))
    assert 0 < sum((y == 0).sum() for _, y in found) <= 2400 and sum((y == 1).sum() for _, y in found) > 0


def test_repeated_rows_push_no_language_out(spark, monkeypatch):
    free = [k for k in range(30) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(free[0], "der die das", "de", "s", 1)] * 30 + [(k, f"the of and {k}", "en", "s", 1) for k in free[:5]] + [(None, "le la les", "fr", "s", 1)]
    found = []
    monkeypatch.setattr(language_crf, "FIT", 2)
    monkeypatch.setattr(language_crf, "train", lambda texts, labels, lexicon, langs: found.extend(labels))
    language_crf.fit(spark.createDataFrame(rows, DOCS))
    assert found == ["de", "en", "en", "fr"]
