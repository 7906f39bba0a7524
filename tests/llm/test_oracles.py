"""Queries with an SQL counterpart, on the smallest test tables."""

import duckdb
import pytest

from boxoffice.llm.queries import ORACLES, QUERIES

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
