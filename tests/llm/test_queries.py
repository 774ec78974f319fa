"""The registered queries and the pipeline on the driver's small tables."""

import pytest

from tally.llm.queries import ORACLES, QUERIES

from ..oracle import check, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf_dir, name):
    check(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def test_quality_against_labels(spark, sf_dir):
    """Given labels are held out: the classifier never reads them."""
    got = QUERIES["op7_weak_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in got) >= 0.9 * len(got)


def test_language_of_held_out_documents(spark, sf_dir):
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language_crf"](spark, sf_dir).where("held_out").join(langs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    from tally.llm._common import written

    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf_dir), "test")
        sizes.append(docs.count())
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert 0 < sizes[2] <= sizes[1] <= sizes[0]
    assert docs.agg({"length": "max"}).first()[0] <= 2048


def test_pipeline_on_hard_cases(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns go through; every id of every kept text is packed once."""
    import random

    import corpus_pipeline
    import numpy as np
    from tally.llm._bpe import Encoder

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randrange(2, 9)))
    clean = [". ".join(" ".join(word() for _ in range(rng.randrange(6, 20))).capitalize() for _ in range(rng.randrange(4, 30))) + "." for _ in range(60)]
    near = clean[3].split()
    near[10] = "changed"
    junk = "### $$$ %%% " * 80
    rows = [(k, t, "en", f"s{k % 3}", len(t), "r", 1) for k, t in enumerate(clean)]
    rows += [(100, clean[3], "en", "s0", 5, "r", 1), (101, " ".join(near), "en", None, 5, "r", 1), (102, junk, "en", "s0", 5, "r", 1), (103, None, None, None, None, None, None), (104, "", "", "", 0, "", 0)]
    rows += [(105, "\n".join(clean[:30]) * 40, "en", "s1", 9, "r", 1), (106, "tail <|endoftext|> " + clean[9][::-1], "en", "s1", 9, "r", 1), (7, clean[7], "en", "s1", len(clean[7]), "r", 1)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, n int"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from tally.llm._common import written

        docs = written(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 102 not in kept["quality classifier"] and len(kept["quality classifier"] & set(range(60))) >= 57
    assert len(kept["simhash near-dedup"] & {3, 100, 101, 105}) <= 2
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encode, want, got = Encoder().whole, {}, {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append((encode(r["text"]) if r["text"] else b"") + np.array([1], "<u4").tobytes())
    for r in sorted(packed, key=lambda r: r["start"]):
        got.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"])))
    assert got.keys() == want.keys()
    for k, texts in want.items():
        assert sum(len(t) for t in texts) == sum(len(b) for _, b in got[k])
        if len(texts) == 1:
            assert b"".join(b for _, b in got[k]) == texts[0]
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
