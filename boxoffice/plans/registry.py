"""Registered queries: a function over the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.plans.mapped import mapped_tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shown(df: DataFrame) -> DataFrame:
    """Money as double, dates and times as text, lists as joined text: types that every engine prints alike."""
    columns = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind.startswith("decimal"):
            col = col.cast("double")
        elif kind.startswith("timestamp"):
            col = F.substring(col.cast("string"), 1, 19)
        elif kind == "date":
            col = col.cast("string")
        elif kind == "array<string>":
            col = F.array_join(col, ", ")
        columns.append(col.alias(name))
    return df.select(*columns)


def query(name: str, sql: str | None, views: dict[str, str] | None = None):
    """Registers ``build(t, read)``; ``read`` gives a test table by name."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = mapped_tables(spark, sf_dir)
            return shown(build(t, lambda source: spark.read.parquet(f"{sf_dir}/{source}.parquet")))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql, views)
        return build

    return register
