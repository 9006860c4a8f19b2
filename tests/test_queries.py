"""Every core query against its SQL on the smallest tables; every query runs."""

import pytest

from hearthmill.queries import ALL_QUERIES, ALL_SQL
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_matches_sql(name, spark, data, con):
    assert compare(ALL_QUERIES[name](spark, data), con, ALL_SQL[name]) is None


def test_every_core_query_has_sql():
    assert set(ALL_QUERIES) == set(ALL_SQL)


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(ALL_QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark, data):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["nation", "n_orders", "avg_price", "median_price"] and df.count() == 25


def test_salted_hot_has_a_hot_key(con):
    """salted_join salts keys with more than 1/64 of the rows."""
    hot = "SELECT count(*) FROM (SELECT seller_id FROM raw_daft_listings WHERE seller_id IN (SELECT seller_id FROM documents) GROUP BY 1 HAVING count(*) * 64 > (SELECT count(*) FROM raw_daft_listings))"
    assert "q_salted_hot" in ALL_QUERIES and con.execute(hot).fetchone()[0] >= 1
