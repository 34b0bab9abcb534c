"""Every registered query against its SQL over the smallest tables."""

import duckdb
import pytest

from tools_check import rows_of
from tracegraph.plans import ORACLES, QUERIES
from tracegraph.sources.starview import TABLES

DIRECTORY = "/root/testdata/sf0.001"
CHECKED_BY_ROWS = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIRECTORY}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, DIRECTORY)
    cur = duck.execute(ORACLES[key])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("key", CHECKED_BY_ROWS)
def test_runs(spark, key):
    assert QUERIES[key](spark, DIRECTORY).count() >= 0
