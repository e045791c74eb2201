import os

import duckdb
import pytest

import __spark_entry__ as entry
from emberlog import queries as kv
from emberlog import store_queries


QUERIES, ORACLE_SQL = kv.QUERIES | store_queries.QUERIES, kv.ORACLE_SQL | store_queries.ORACLE_SQL_STORE
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    out = QUERIES[name](spark, DATA)
    columns = sorted(out.columns)
    ours = sorted(map(repr, (tuple(r[c] for c in columns) for r in out.collect())))
    theirs = sorted(map(repr, con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()))
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 191
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
