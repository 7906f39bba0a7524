"""A report and its totals in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation

from boxoffice.session import staged


def with_totals(report: DataFrame, name: str, **totals: Column) -> tuple[DataFrame, DataFrame]:
    """The report as a table in the shared folder, and its totals as one row, counted while the table is written.

    The totals are observed in the tasks that write, each of which counts once however often one is repeated. For
    the same reason the report should not be sorted as a whole: a sort reads its rows twice.
    """
    seen = Observation()
    columns = [c.alias(n) for n, c in totals.items()]
    table = staged(report.observe(seen, *columns), name)
    return table, report.sparkSession.createDataFrame([tuple(seen.get[n] for n in totals)], report.agg(*columns).schema)
