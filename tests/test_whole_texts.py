"""Queries that must see all of a text."""

from pyspark.sql import functions as F

from tally.plans.queries import ORACLES, QUERIES

from .oracle import check, connect


def _documents(spark, folder):
    head = "Same Head " * 30
    rows = [(1, head + "Z/last"), (2, head + "a  LAST"), (3, "short"), (4, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_whole_texts(spark, tmp_path):
    d = _documents(spark, tmp_path)
    con = connect(d)
    for name in ("normalize_text", "ascii_nocase_text_sort"):
        assert check(QUERIES[name](spark, d), con, ORACLES[name]) == 4
    names = {r["doc_id"]: r["name"] for r in QUERIES["normalize_text"](spark, d).collect()}
    assert names[1].endswith("z_last") and names[2].endswith("a last")
    order = [r["doc_id"] for r in QUERIES["ascii_nocase_text_sort"](spark, d).where(F.col("text").isNotNull()).collect()]
    assert order == [2, 1, 3]
