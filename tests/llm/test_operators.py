"""Each operator on a small table of hard cases, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tally.llm import interpolation, language_crf, line_dedup, mixing, packing, permutation_index, quality_rules, simhash, tokenfile, weak_quality
from tally.llm._bpe import public_path
from tally.llm._common import block_masks
from tally.llm.graph import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, fp bigint, root string, n bigint, h string"
WORDS = {
    "en": "the of and house river walking bright under garden stone would there which evening people through",
    "de": "der die und schönes straße gehen über garten steine würde welche abends menschen durch nicht zwischen",
}


def prose(rng, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang].split()) + (".\n" if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(60):
        lang = "en" if k % 3 else "de"
        out.append([k, prose(rng, lang, rng.randrange(1, 150)), lang, f"s{k % 4}"])
    base = out[7][1]
    out += [[100 + k, base, "en", "s0"] for k in range(5)]  # exact copies
    out += [[110 + k, base + f" tail{k}", "en", "s0"] for k in range(4)]  # near copies
    out += [
        [200, None, None, None], [201, "", "en", None], [202, " \t\n\x0b ", "en", "s1"], [203, "one", "en", "s1"], [204, "123 456 !!", None, ""],
        [205, prose(rng, "en", 30_000), "en", "s2"], [206, "\x1c\x85 a b É　x", "en", "s2"], [7, base, "en", "s0"], [None, "no id here at all today", "en", "s3"],
        [207, "spam### $$$ ***" * 60, "en", "s3"], [208, "x" * 5000, "en", "s3"], [209, "𝄞 日本語 \n\n 日本語", "ja", "s3"],
        [210, "a <|endoftext|> b", "en", "s3"], [211, "x<|endoftext|><|endoftext|> y  z", "en", "s3"],
    ]
    return [(i, t, lang, s, None if t is None else len(t), 1, 2, "r", 3, "h") for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    """Ids of a text as the tokenizers library alone gives them, little-endian."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_path())
    return lambda text: np.array(fresh.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# op1 ---------------------------------------------------------------------------


def fingerprint(text, k=4):
    w = words(low(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash(docs, rows, empty):
    fps = [fingerprint(r[1]) for r in rows]
    comp = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4])
    least = defaultdict(lambda: None)
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[comp[k]] = r[0] if least[comp[k]] is None else min(least[comp[k]], r[0])
    want = Counter((r[0], f"{fps[k]:016x}", least[comp[k]]) for k, r in enumerate(rows))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.drop_near_duplicates(docs, 4)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(comp))
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_join_loses_no_link():
    rng = np.random.default_rng(1)
    for _ in range(20):
        near = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 8)))) for b in rng.integers(0, 2**63, 12) for _ in range(30)]
        fps = np.unique(np.array(near, np.uint64))
        want = np.arange(len(fps))
        a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4, 1))
        simhash._unite(want, a, b)
        assert (simhash.trie_join(np.zeros(len(fps), int), fps) == want).all()


def test_components_of_stars_chains_and_random_edges(spark):
    """Edges that are stars already, none at all, loops, and graphs that need some rounds."""
    rng = random.Random(3)
    for pairs in ([], [(1, 1)], [(2, 1), (3, 1), (5, 4)], [(3, 1), (3, 2), (2, 0)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]):
        pairs = [(u + 1, v + 1) for u, v in pairs]
        names = sorted({x for p in pairs if p[0] != p[1] for x in p})
        root, least = union(len(names), [(names.index(u), names.index(v)) for u, v in pairs if u != v]), {}
        for k, x in enumerate(names):
            least.setdefault(root[k], x)
        got = [(r["node"], r["root"]) for r in components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()]
        assert sorted(got) == [(x, least[root[k]]) for k, x in enumerate(names)]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99, 100: 99}


# op2 ---------------------------------------------------------------------------


def test_quality_rules(docs, rows, empty):
    got = Counter(tuple(r)[:8] for r in quality_rules.judge(docs, limit_docs=3, limit_share=0.05).collect())
    line = lambda x: " ".join(words(low(x).translate(str.maketrans("123456789", "0" * 9))))
    held, size = Counter(), Counter()
    for r in rows:
        size[r[3]] += 1
        for x in {line(x) for x in (r[1] or "").split("\n") if words(x)}:
            held[r[3], x] += 1
    want = Counter()
    for r in rows:
        text = r[1] or ""
        w = words(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        gone = sum(len(words(x)) for x in lines if held[r[3], line(x)] > max(3, 0.05 * size[r[3]]))
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), failed, not failed and 2 * gone <= len(w)] += 1
    assert got == want
    assert quality_rules.judge(empty).count() == 0
    left = quality_rules.without_frequent_lines(docs, 3, 0.05)
    assert left.columns == docs.columns and quality_rules.without_frequent_lines(empty).count() == 0
    gone = lambda s, x: words(x) and held[s, line(x)] > max(3, 0.05 * size[s])
    kept = Counter((r[0], r[1] and "\n".join(x for x in r[1].split("\n") if not gone(r[3], x)), r[9]) for r in rows)
    assert Counter((r["doc_id"], r["text"], r["h"]) for r in left.collect()) == kept and sum(any(gone(r[3], x) for x in (r[1] or "").split("\n")) for r in rows) > 3


def test_names_of_the_operators_own(spark):
    """Columns that carry the names used inside pass through."""
    names = ["doc", "part", "n", "rate", "target", "no_source", "source_size", "_mix_null", "_keep_id", "keep_id", "h", "keep_h", "row", "gone", "_gone", "id", "fp"]
    text = "the line that is here in all of them\nand another one number "
    table = spark.createDataFrame([(k, text + "abcdefgh"[k], "s", *[f"{k}-{c}" for c in names]) for k in range(8)] + [(3, text + "d", "s", *[f"3-{c}" for c in names])], f"doc_id bigint, text string, source string, {', '.join(c + ' string' for c in names)}")
    for got in (mixing.mix(table), simhash.drop_near_duplicates(table, 5, 0.8), simhash.drop_near_duplicates(table), quality_rules.without_frequent_lines(table, 3, 0.05), line_dedup.dedup(table), weak_quality.keep_good(table)):
        assert got.columns == table.columns
        assert all(r[c] == f"{r['doc_id']}-{c}" for r in got.collect() for c in names)
    assert mixing.mix(table).count() >= 9


# op3 ---------------------------------------------------------------------------


def test_packing(docs, rows, empty):
    out = packing.pack(docs, keep_ids=True).collect()
    encode = library()
    want = Counter((r[0], (encode(r[1]) if r[1] else b"") + np.array([1], "<u4").tobytes()) for r in rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, pieces in by_doc.items():
        texts = [t for (i, t), n in want.items() if i == doc_id for _ in range(n)]
        assert sum(p["length"] for p in pieces) == sum(len(t) // 4 for t in texts)
        if len(texts) == 1:
            assert b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"])) == texts[0]
    assert set(by_doc) == {i for i, _ in want}
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.SIZE
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    assert padding <= 0.1 * total
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand = np.bincount(np.minimum(64, 1 + rng.gamma(1.1, 9 + 5 * seed, 3000).astype(int)), minlength=65)[1:]
    plan = packing.plan_patterns(demand)
    size = np.arange(1, 65)
    assert all((p * size).sum() <= 64 for p, _ in plan)
    assert (sum(p * n for p, n in plan) >= demand).all()
    bound = sum(x for _, x in packing.column_generation(demand))
    assert sum(n for _, n in plan) <= bound + 6


def test_knapsack_against_all_multisets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        value = rng.random(9) * np.arange(1, 10)
        best = [0.0] * 10
        for w in range(1, 10):
            best[w] = max([best[w - 1], *(best[w - c] + value[c - 1] for c in range(1, w + 1))])
        gain, pattern = packing.knapsack(value, 9)
        assert math.isclose(gain, best[9]) and math.isclose((pattern * value).sum(), gain) and (pattern * np.arange(1, 10)).sum() <= 9


# op4 ---------------------------------------------------------------------------


def test_line_dedup(spark, docs, rows, empty):
    base = "a long line of quite some words that stays the same all over the place for everyone who reads it today 1"
    many = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    near = [" ".join([*many[:k], "zz" + many[k], *many[k + 1 :]]) for k in range(0, 100, 9)] + [" ".join(many), " ".join(many[:70] + ["yy"] * 30)]
    near += [base.replace("1", str(k)) for k in range(3)] + [base + " x", base.replace("quite", "quit"), "short line", "short line", "", base + " " + "more " * 400, base + " " + "more " * 400 + "end"]
    extra = spark.createDataFrame([(500 + k, "\n".join(["head of its own with number %d in words" % k if k % 2 else "ok", x]), "en", "s", 1, 1, 2, "r", 3, "h") for k, x in enumerate(near)], SCHEMA)
    table = docs.unionByName(extra).where("doc_id is not null")
    got = {}
    for r in line_dedup.dedup(table, counts=True).collect():
        got.setdefault(r["doc_id"], []).append(r)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]", "0", x.lower())).strip(" ")
    all_rows = sorted(((r["doc_id"], r["text"]) for r in table.collect()), key=lambda r: r[0])
    ids, where = {}, []
    for at, (_, text) in enumerate(all_rows):
        for k, x in enumerate((text or "").split("\n")):
            if len(norm(x).split(" ")) >= 5:
                where.append((at, k, ids.setdefault(norm(x), len(ids))))
    names = list(ids)

    def bits(x):
        h = {xxhash.xxh64_intdigest(w.encode(), 42) for w in x.split(" ")}
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    def distance(a, b):
        row = np.arange(len(b) + 1)
        codes = np.array(list(b))
        for i, c in enumerate(a):
            after = np.concatenate(([i + 1], np.minimum(row[1:] + 1, row[:-1] + (codes != c))))
            row = np.minimum.accumulate(after - np.arange(len(after))) + np.arange(len(after))
        return row[-1]

    def similar(a, b):
        return any(distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-6) for x, y in ((a.split(" "), b.split(" ")), (a, b)))

    hashes, less = np.array([bits(x) for x in names], np.uint64), defaultdict(set)
    pairs = {(int(a), int(b)) for a, h in enumerate(hashes) for b in np.flatnonzero(np.bitwise_count(hashes[:a] ^ h) <= 3)}
    for a, x in enumerate(names):
        w = x.split(" ")
        for rest in [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))] if len(w) <= 32 else ():
            less[tuple(sorted(rest))].add(a)
    pairs |= {(a, b) for same in less.values() for a in same for b in same if b < a}
    links = [(a, b) for a, b in pairs if similar(names[a], names[b])]
    root = union(len(names), links)
    seen, gone = set(), set()
    for at, k, x in where:
        if root[x] in seen:
            gone.add((at, k))
        seen.add(root[x])
    cut = lambda at, text: text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (at, k) not in gone)
    want = Counter((i, cut(at, text), sum(g == at for g, _ in gone)) for at, (i, text) in enumerate(all_rows))
    assert links and len(links) > len({root[x] for x, _ in links})
    assert Counter((i, r["text"], r["n_removed"]) for i, rs in got.items() for r in rs) == want
    kept = line_dedup.dedup(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 200").first()["text"] is None
    assert line_dedup.dedup(empty).count() == 0
    assert line_dedup.dedup(empty, runs=True).count() == 0


def test_line_simhash_of_any_length(spark):
    rng = np.random.default_rng(4)
    lists = [rng.integers(-(2**63), 2**63, n).tolist() for n in (1, 2, 5, 62, 63, 64, 126, 127, 500, 20_000)]
    table = spark.createDataFrame([(len(x), x) for x in lists], "k int, hashes array<bigint>")
    got = line_dedup.simhashes(table, ["k"]).orderBy("k").collect()
    for x, r in zip(lists, got, strict=True):
        v = np.array(x).view(np.uint64)
        assert r["sh"] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * int((v >> np.uint64(b) & np.uint64(1)).sum()) > len(v))


def test_line_hashes_reach_their_counters_by_eights(spark):
    """A row for eight hashes of a line, the last filled up with zeros, and every hash in one of them."""
    rng = np.random.default_rng(5)
    lists = [rng.integers(1, 2**63, n).tolist() for n in (1, 7, 8, 9, 64, 65, 20_000)] + [[]]
    table = spark.createDataFrame([(len(x), x) for x in lists], "k int, hashes array<bigint>")
    got = defaultdict(list)
    for r in line_dedup.eights(table, ["k"]).collect():
        got[r["k"]].append([r[f"h{j}"] for j in range(8)])
    assert {k: len(v) for k, v in got.items()} == {len(x): -(-len(x) // 8) for x in lists if x}
    assert all(sorted(h for r in got[len(x)] for h in r if h) == sorted(x) for x in lists)


def test_line_dedup_of_short_lines_but_for_one_word(spark):
    """Repeated words count as often as they stand: a replaced, an added and a lost one are found, two are not."""
    lines = ["red red blue green white black", "red red blue green white brown", "red red blue green white black red", "red red blue green white", "blue red red blue pink pink black lime navy gold", "red pink pink black lime navy gold teal teal blue"]
    table = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in line_dedup.dedup(table).collect()} == {0, 4, 5}


def test_line_blocks_find_every_pair_within_the_budget():
    for budget, blocks in ((line_dedup.BUDGET, line_dedup.BLOCKS), (simhash.BUDGET, simhash.BLOCKS)):
        for _, agree in blocks:
            masks = block_masks(budget, agree)
            for d in ((), (0,), (0, 13, 26), (5, 6, 7), (12, 13, 63), (20, 40, 60), (0, 20, 40, 60), (1, 2, 3, 4))[: 6 if budget == 3 else 8]:
                assert any(not any(m >> b & 1 for b in d) for m in masks)
            assert all(m < 1 << 64 for m in masks)


def test_simhash_links_of_any_blocks(spark, monkeypatch):
    """The same components whichever blocks agree."""
    rng = np.random.default_rng(6)
    near = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 64, rng.integers(0, 7)))) for b in rng.integers(0, 2**63, 60) for _ in range(12)]
    fps = np.unique(np.array(near, np.uint64)).view(np.int64).tolist()
    table, found = spark.createDataFrame([(x,) for x in fps], "fp bigint"), []
    for agree in (1, 2, 3):
        monkeypatch.setattr(simhash, "BLOCKS", ((1 << 62, agree),))
        found.append({r["node"]: r["root"] for r in components(simhash.links(table)).collect()})
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4]
    root = union(len(fps), pairs)
    least = {}
    for k, x in enumerate(fps):
        least[root[k]] = min(least.get(root[k], x), x)
    want = {x: least[root[k]] for k, x in enumerate(fps) if root.count(root[k]) > 1}
    assert found == [want] * 3


def test_line_dedup_of_a_hot_group(spark):
    """Hundreds of lines whose SimHashes lie close together, beside names that the operator uses itself."""
    rng, words_ = random.Random(2), [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100]}" for k in range(300)]
    texts = [" ".join([*words_[:k], *words_[k + 1 :]]) for k in range(200)] + [" ".join(rng.sample(words_, 300)) for _ in range(3)]
    table = spark.createDataFrame([(k, x, k, -k, "p", "c", "g", 5) for k, x in enumerate(texts)], "doc_id bigint, text string, row bigint, doc bigint, pos string, cut string, gone string, sh int")
    kept = line_dedup.dedup(table)
    assert kept.columns == table.columns
    assert {(r["doc_id"], r["row"], r["doc"], r["pos"]) for r in kept.collect()} == {(k, k, -k, "p") for k in (0, 200, 201, 202)}


# op5 ---------------------------------------------------------------------------


def test_interpolation(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(interpolation, "CHUNK", 500)
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    tokens = [(r[0], [*words(low(r[1])), None]) for r in rows]
    count = Counter(w for i, t in tokens if part(i) != 2 for w in t)
    n, v = sum(count.values()), len(count)
    got = defaultdict(list)
    for r in interpolation.score(docs).collect():
        got[r["doc_id"]].append(r)
        assert r["score"] < 0 and r["train_tokens"] == n and r["held_out"] == (part(r["doc_id"]) == 2)
    for i, t in tokens:
        base = sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in t)
        assert any(math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(t) and r["n_known"] == sum(count[w] > 0 for w in t) for r in got[i])
    held = [r for rs in got.values() for r in rs if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert interpolation.score(empty).count() == 0


def test_interpolation_scores_against_a_plain_model(docs, rows, monkeypatch):
    """Weights by EM on exact ratios and scores in plain Python: the operator's histogram keeps within a percent."""
    monkeypatch.setattr(interpolation, "CHUNK", 700)
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    texts = [(r[0], [*words(low(r[1])), None]) for r in rows]

    def counts(parts):
        one, two = Counter(), Counter()
        for i, t in texts:
            if part(i) in parts:
                one.update(t)
                two.update(zip([None, *t], t, strict=False))
        return one, two

    def em(pairs):
        weight = 0.5
        for _ in range(300):
            weight = sum(weight * x / (weight * x + (1 - weight) * y) for x, y in pairs) / len(pairs) if pairs else 0.0
        return min(max(weight, 1e-6), 1 - 1e-6) if pairs else 0.0

    counted, trained = counts({0, 1, 4, 5, 6}), counts({0, 1, 3, 4, 5, 6})
    dev = [(h, w) for i, t in texts if part(i) == 3 for h, w in zip([None, *t], t, strict=False)]
    (one, two), n = counted, counted[0].total()
    a = em([(one[w] / n, 1 / (len(one) + 1)) for _, w in dev])
    p1 = lambda one, w: a * one[w] / one.total() + (1 - a) / (len(one) + 1)
    level = lambda one, h: int(math.log2(one[h])) + 1 if one[h] else 0
    by_level = defaultdict(list)
    for h, w in dev:
        by_level[level(one, h)].append((two[h, w] / one[h] if one[h] else 0, p1(one, w)))
    b = {k: em(v) if k else 0.0 for k, v in by_level.items()}
    (one, two), want = trained, defaultdict(list)
    for i, t in texts:
        logs = 0.0
        for h, w in zip([None, *t], t, strict=False):
            mix = b.get(level(one, h), 0.0)
            logs += math.log10((mix * two[h, w] / one[h] if one[h] else 0) + (1 - mix) * p1(one, w))
        want[i].append(logs)
    for r in interpolation.score(docs).collect():
        assert any(math.isclose(r["score"], x, rel_tol=0.01) for x in want[r["doc_id"]]), r


def test_probabilities_sum_to_one():
    """Over the known words and one unknown word, P(. | h) is a distribution."""
    words_, pairs = {"a": 3, "b": 1}, {("a", "b"): 1, ("a", "a"): 2}
    n, v, a, b = 4, 2, 0.9, 0.7
    p1 = lambda w: a * words_.get(w, 0) / n + (1 - a) / (v + 1)
    total = sum(b * pairs.get(("a", w), 0) / 3 + (1 - b) * p1(w) for w in ("a", "b", "new"))
    assert math.isclose(total, 1)


def test_mixture_weight_maximises():
    ratios, counts = np.array([0.0, 0.5, 4.0]), np.array([5.0, 10.0, 20.0])
    likelihood = lambda x: (counts * np.log(x * ratios + 1 - x)).sum()
    best = interpolation.mixture_weight(ratios, counts)
    assert all(likelihood(best) >= likelihood(x) - 1e-6 for x in np.linspace(0.01, 0.99, 99))
    assert interpolation.mixture_weight(ratios, counts * 0) == 0


# op6 ---------------------------------------------------------------------------


def test_language(docs, rows, empty):
    got = {(r["doc_id"], r["lang_pred"]): r for r in language_crf.identify(docs).collect()}
    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 3
    assert all(r["held_out"] == (part(r["doc_id"]) == 1) and 0 <= r["score"] <= 1 for r in got.values())
    for i in (200, 201, 202, 204):
        assert got[i, "und"]["score"] == 0
    held = [r for r in rows if r[0] is not None and r[0] < 60 and part(r[0]) == 1 and len(words(r[1])) > 3]
    assert sum((r[0], r[2]) in got for r in held) >= 0.95 * len(held)
    assert language_crf.identify(empty).count() == 0


def test_words_of_switched_text(spark, docs):
    """A text that changes its language twice: its words are labelled, and its language is the one of most letters."""
    rng = random.Random(31)
    parts = [[w.strip(".\n") for w in prose(rng, lang, 40).split()] for lang in ("en", "de", "en")]
    truth = [lang for lang, p in zip(("en", "de", "en"), parts, strict=True) for _ in p]
    text = " ".join(w for p in parts for w in p)
    mixed = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["langs"] for r in language_crf.label_words(mixed, docs).collect()}
    assert got[2] == got[3] == [] and len(got[1]) == len(truth)
    assert sum(a == b for a, b in zip(got[1], truth, strict=True)) >= 0.9 * len(truth)


def test_language_against_all_paths(docs, rows):
    """A text's shares are those of a sum over all labellings of its words."""
    import itertools

    model = language_crf.fit(docs).open()
    n = len(model.langs)
    for text in ("the river der", "straße", "house of 12 steine über", "über the"):
        words_ = text.encode().split()
        emit, size = model.look(words_)[:, :-1], model.look(words_)[:, -1]
        share, total = np.zeros(n), 0.0
        for path in itertools.product(range(n), repeat=len(words_)):
            p = model.start[path[0]] * math.exp(sum(emit[k, c] for k, c in enumerate(path))) * math.prod(model.moves[a, b] for a, b in zip(path, path[1:], strict=False))
            total += p
            for k, c in enumerate(path):
                share[c] += p * size[k]
        lang, score = model.predict([text.encode()])[0]
        assert lang == model.langs[int(share.argmax())] and math.isclose(score, share.max() / total / size.sum(), rel_tol=1e-6)


def test_forward_backward_against_all_paths():
    import itertools

    rng = np.random.default_rng(0)
    sizes, n = np.array([3, 1, 0, 4, 6]), 3
    emissions, start, moves = rng.normal(size=(14, n)), rng.random(n), rng.random((n, n))
    for block in (1, 2, 5):
        assert np.allclose(language_crf.forward_backward(emissions, sizes, start, moves, block), language_crf.forward_backward(emissions, sizes, start, moves))
    got, at = language_crf.forward_backward(emissions, sizes, start, moves), 0
    for s in sizes:
        want = np.zeros((s, n))
        for path in itertools.product(range(n), repeat=int(s)) if s else ():
            p = start[path[0]] * np.exp(sum(emissions[at + i, c] for i, c in enumerate(path))) * np.prod([moves[a, b] for a, b in zip(path, path[1:], strict=False)])
            for i, c in enumerate(path):
                want[i, c] += p
        assert np.allclose(want / want.sum(1, keepdims=True), got[at : at + s]) if s else True
        at += s


# op7 ---------------------------------------------------------------------------


def test_weak_quality(docs, empty):
    got = {r["doc_id"]: r for r in weak_quality.classify(docs).collect()}
    assert not got[207]["kept"]
    assert sum(got[k]["kept"] for k in range(60)) >= 50
    assert weak_quality.classify(empty).count() == 0
    kept = weak_quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == weak_quality.classify(docs).where("kept").count()


def test_weak_quality_against_a_plain_version(docs, rows):
    """Measures, votes, posteriors and scores of every text, each written anew."""

    def measures(text):
        w = (text or "").encode().split()
        if not w:
            return [0] * 7 + [1.0, 0]
        n, lines = len(w), [x for x in text.encode().split(b"\n") if x.strip()]
        grams = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
        cover = {i + k for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        bare = lambda x: not any(65 <= b <= 122 or b > 127 or 48 <= b <= 57 for b in x)
        return [
            len(re.findall(r"[#*$%&|<>]", text)) / n, sum(x.isupper() and len(x) > 1 for x in w) / n, (len(lines) - len(set(lines))) / max(1, len(lines)), len(cover) / n,
            sum(bool(re.search(rb"[^\w\s\x80-\xff]{2,}$", x)) for x in w) / n, sum(map(bare, w)) / n, sum(len(x) < 2 or len(x) > 25 for x in w) / n, 2 / (n + 1), sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        ]

    votes = [tuple(1 if x > bad else 2 if x <= good else 0 for x, (_, bad, good) in zip(measures(r[1]), weak_quality.LABELLERS, strict=True)) for r in rows]
    good = [min(max((v.count(2) + 1) / (len(v) - v.count(0) + 2), 0.05), 0.95) for v in votes]
    good = [min(g, 0.4) if 1 in v else g for g, v in zip(good, votes, strict=True)]
    for _ in range(100):
        prior, odds = (sum(good) + 1) / (len(good) + 2), [0.0] * len(votes)
        for k in range(len(votes[0])):
            cast = [(v[k], g) for v, g in zip(votes, good, strict=True) if v[k]]
            for x in (1, 2):
                yes = (sum(g for v, g in cast if v == x) + 1) / (sum(g for _, g in cast) + 2)
                no = (sum(1 - g for v, g in cast if v == x) + 1) / (sum(1 - g for _, g in cast) + 2)
                odds = [o + math.log(yes / no) * (v[k] == x) for o, v in zip(odds, votes, strict=True)]
        after = [1 / (1 + math.exp(-min(30, max(-30, o + math.log(prior / (1 - prior)))))) for o in odds]
        done, good = max(abs(a - b) for a, b in zip(after, good, strict=True)) < 1e-6, after
        if done:
            break
    want = defaultdict(list)
    for r, g in zip(rows, good, strict=True):
        want[r[0]].append(g)
    got = weak_quality.classify(docs).collect()
    assert len(got) == len(rows) and all(any(math.isclose(r["weak_label"], g, abs_tol=1e-4) for g in want[r["doc_id"]]) for r in got)
    # the scorer agrees with the labels that it was trained on, where these are clear
    clear = [r for r in got if abs(r["weak_label"] - 0.5) > 0.4]
    assert sum(r["kept"] == (r["weak_label"] > 0.5) for r in clear) >= 0.95 * len(clear)


def test_estimates_find_the_better_labellers():
    """Votes of labellers with known accuracies: EM orders them, and beats a majority."""
    rng = np.random.default_rng(2)
    truth = rng.random(5000) < 0.8
    skill = [0.95, 0.9, 0.6, 0.55, 0.9, 0.85, 0.7, 0.9, 0.9]
    votes = np.stack([np.where(rng.random(5000) < 0.2, 0, np.where((rng.random(5000) < s) == truth, 2, 1)) for s in skill], axis=1)
    patterns, back, counts = np.unique((votes * 3 ** np.arange(len(skill))).sum(1), return_inverse=True, return_counts=True)
    post = weak_quality.estimate(patterns, counts.astype(float))[back]
    majority = (votes == 2).sum(1) >= (votes == 1).sum(1)
    assert ((post > 0.5) == truth).mean() >= max(0.95, (majority == truth).mean())


# op8 ---------------------------------------------------------------------------


def test_permutation_index(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:1000] = x[500]
    rows = [(int(k), [float(v) for v in x[k]]) for k in range(1500)]
    rows += [(1500, None), (1600, [0.0] * 16), (1700, [float("nan")] * 16), (1800, [1.0] * 15 + [None]), (1900, [1.0] * 3), (0, rows[1][1])]
    table = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id bigint, embedding array<float>, block int, q_block string")
    got = defaultdict(list)
    for r in permutation_index.search(table).orderBy("rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 1500, 100))
    valid = [(i, np.array(v)) for i, v in rows if v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)]
    ids, data = np.array([i for i, _ in valid]), np.array([np.float32(v) for _, v in valid], float)
    hits = 0
    for q in range(100, 1500, 100):
        d = np.sqrt(((data - x[q].astype(float)) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        found = dict(got[q])
        hits += len(found.keys() & {int(ids[k]) for k in order})
        assert all(math.isclose(s, d[np.flatnonzero(ids == i)].min(), abs_tol=1e-9) or i == 0 for i, s in got[q])
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert hits >= 0.9 * 140
    assert permutation_index.search(table.where("vec_id < 0")).count() == 0
    few = permutation_index.search(table.where("vec_id in (100, 101, 102)")).collect()
    assert [(r["rank"], r["query_id"]) for r in few] == [(1, 100), (2, 100)]


def test_permutation_index_of_repeated_rows(spark):
    """Rows of a query that are repeated, as they are or with another vector, are one query; ties and copies count."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 8)).astype(np.float32).astype(float)
    rows = [(k, x[k]) for k in range(300)] + [(100, x[100]), (200, x[5]), (0, x[0]), (7, x[7]), (7, x[7]), (301, x[7])]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in permutation_index.search(table).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    for q in (0, 100, 200):
        mine = [v for i, v in rows if i == q]
        near = sorted((round(min(float(np.sqrt(((v - m) ** 2).sum())) for m in mine), 9), i) for i, v in rows if i != q)[:10]
        assert got[q] == [(k + 1, i, d) for k, (d, i) in enumerate(near)]


def test_permutation_index_of_many_blocks(spark, monkeypatch):
    """Pairs of query and index blocks are made where they are read: the driver sends no copy of the queries for each index block."""
    monkeypatch.setattr(permutation_index, "BLOCK", 32)
    monkeypatch.setattr(permutation_index, "QUERIES", 8)
    monkeypatch.setattr(permutation_index, "RERANK", 32)
    x = np.random.default_rng(3).normal(size=(3000, 16)).round(3)
    table = spark.createDataFrame([(k, x[k].tolist()) for k in range(3000)], "vec_id bigint, embedding array<double>").repartition(3)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100k")
    try:
        got = [tuple(r) for r in permutation_index.search(table).orderBy("query_id", "rank").collect()]
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    want = []
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        near = [k for k in np.lexsort((np.arange(3000), d)) if k != q][:10]
        want += [(q, r + 1, int(k), d[k]) for r, k in enumerate(near)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want])


# op9 ---------------------------------------------------------------------------


def test_token_files(docs, rows, empty, monkeypatch):
    out = tokenfile.encode_table(docs).collect()
    encode = library()
    want = [(r[0], (encode(r[1]) if r[1] else b"") + np.array([2], "<u4").tobytes()) for r in rows]
    at, got = 0, sorted(out, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in want), key=lambda i: (i is not None, i))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == Counter((i, len(b) // 4, zlib.crc32(b)) for i, b in want)
    assert tokenfile.encode_table(empty).count() == 0


@pytest.mark.parametrize("base", [300, 50257, 70_000])
def test_grammar_round_trip(base):
    rng = np.random.default_rng(base)
    for n in (0, 1, 2, 50, 5000):
        ids = rng.zipf(1.4, n) % min(base, 40)
        ids[: n // 3] = 7  # runs of one id
        shard = tokenfile.Shard(tokenfile.compress(ids, base))
        assert (shard.ids() == ids).all()
        for a in range(0, n, max(1, n // 9)):
            for k in (0, 1, 17, n):
                assert (shard.ids(a, a + k) == ids[a : a + k]).all()
    assert len(tokenfile.compress(np.tile([1, 2, 3, 4], 2000), base)) < 300
    assert len(tokenfile.compress(np.full(8000, 9), base)) < 300


def test_grammar_leaves_no_frequent_pair():
    ids = np.random.default_rng(3).zipf(1.3, 20_000) % 60
    for least in (2, 8, 50):
        seq = tokenfile.Shard(tokenfile.compress(ids, 300, least)).seq.tolist()
        found, last = Counter(), None
        for k, pair in enumerate(zip(seq, seq[1:], strict=False)):
            if pair[0] == pair[1] and last == (pair, k - 1):  # overlaps the one before
                last = None
                continue
            found[pair], last = found[pair] + 1, (pair, k)
        assert max(found.values()) < least


# op10 --------------------------------------------------------------------------


def test_mixing(spark, docs, rows, empty):
    got = mixing.plan_mix(docs)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else share
        if not over:
            break
        left -= sum(3 * size[s] for s in over)
        open_ -= over
    found = {r["source"]: (r["source_size"], r["target"]) for r in got.collect()}
    assert {s: v[0] for s, v in found.items()} == dict(size)
    assert all(math.isclose(found[s][1], target[s], rel_tol=1e-9, abs_tol=1e-9) for s in names)
    assert got.where("taken > 3 * size or taken < 0").count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == got.agg(F.sum("copies")).first()[0]
    assert sorted(map(str, mixing.plan_mix(docs).collect())) == sorted(map(str, got.collect()))
    assert mixing.plan_mix(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mix_meets_targets(spark):
    many = spark.range(40_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    out = mixing.plan_mix(many).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("x")).collect()
    assert all(abs(r["x"] - r["t"]) <= 0.05 * r["t"] for r in out)
