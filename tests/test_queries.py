"""Every named query against DuckDB on the same tables."""

import pytest

from tally.plans import formats, further, pages, reconcile, store_queries  # noqa: F401  add their queries
from tally.plans.queries import ORACLES, QUERIES

from .oracle import check, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        check(df, con, ORACLES[name])
    else:
        df.collect()


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans(spark, sf_dir):
    """Shapes that matter at scale: limits before shuffles, pushed filters, no cross products of tables."""
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan("pick_per_group")
    assert "TakeOrderedAndProject" in plan("keyset_page")
    assert "PushedFilters: [IsNotNull(url), GreaterThanOrEqual(url,https://)" in plan("prefix_range")
    for name in ("tiered_hash_match", "fuzzy_size_bucket", "best_offer_per_item", "snapshot_diff"):
        assert "CartesianProduct" not in plan(name) and "BroadcastNestedLoopJoin" not in plan(name), name
