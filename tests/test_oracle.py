"""Every registered query with oracle SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from loamdex.plans import catalog

from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows(spark, duck, name):
    ours, theirs = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    """Queries without SQL: the same rows twice, and some where the tables have any for them."""
    first, second = (rows(catalog.queries()[name](spark, SF).toPandas()) for _ in range(2))
    assert first == second and first
