"""Every key against its SQL, run by DuckDB over the same files."""

import duckdb
import pytest

from demandlake import queries as core

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ROWS_ONLY = {
    "forecast_monthly", "forecast_weekly", "sample_10pct", "demand_predict", "price_recommend",
    "customer_clusters",
}
SLOW = {"demand_predict", "price_recommend"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_keys_and_sql_agree():
    assert set(core.queries()) - set(core.oracle_sql()) == ROWS_ONLY
    assert set(core.oracle_sql()) <= set(core.queries())
    assert len(core.queries()) == 62


@pytest.mark.parametrize("key", sorted(set(core.queries()) - ROWS_ONLY))
def test_key_matches_sql(spark, sf_dir, duck, key):
    df = core.queries()[key](spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(row[c] for c in names) for row in df.collect()), key=repr)
    result = duck.execute(core.oracle_sql()[key])
    order = [d[0] for d in result.description]
    assert sorted(order) == names
    theirs = sorted((tuple(row[order.index(c)] for c in names) for row in result.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("key", sorted(ROWS_ONLY - SLOW))
def test_key_has_rows(spark, sf_dir, key):
    assert core.queries()[key](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
