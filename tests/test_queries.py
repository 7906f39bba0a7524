"""Every registered query on the smallest test tables, against its SQL in DuckDB."""

import math
import os

import pytest

import __spark_entry__ as entry
from boxoffice.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


SLOW_PLANS = ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name, capsys):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    df.explain()
    plan = capsys.readouterr().out
    assert not [word for word in SLOW_PLANS if word in plan], "pairs or Python in the plan"
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert bag(df.columns, rows) == bag(columns, result.fetchall())


def test_filters_and_columns_reach_the_files(spark, capsys):
    entry.queries()["r35_order_totals"](spark, FOLDER).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
    entry.queries()["r15_ticket_register_own"](spark, FOLDER).explain("formatted")
    assert "EqualTo(c_custkey,9)" in capsys.readouterr().out


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "is_full" in df.columns


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
