"""Rows that wait for each other: the components of a conflict graph, and an ordered pass through each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from boxoffice.operators.spread import spread_join
from boxoffice.session import drop_staged, staged

# Rows of a component that one task walks through in order; larger components go in rounds.
COMPONENT_ROWS = 100_000


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of ids -> ``(id, component)``: the smallest id that each id with a link to another reaches.

    Alternates two steps over written tables until nothing changes, which takes about log(n) rounds: every id
    tells its larger neighbours, then its smaller ones, of the smallest id that it knows.
    """
    now, seen = _written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        after, mark = _written(_towards_smaller(_towards_larger(now)))
        drop_staged(now)
        if mark == seen:
            roots = after.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return after.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        now, seen = after, mark


def _written(pairs: DataFrame) -> tuple[DataFrame, dict]:
    """The pairs as a table, and figures that tell two such tables apart, taken while it is written."""
    seen = Observation()
    marked = pairs.observe(
        seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("a"), F.sum(F.hash("u", "v").cast("long")).alias("b")
    )
    table = staged(marked, "links")
    return table, seen.get


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """``(u, v)``: the pairs of columns of each row, one below the other. Not as a union, which would plan and compute ``rows`` once per pair."""
    of_row = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return rows.select(F.explode(of_row).alias("p")).select("p.u", "p.v")


def _with_least(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return spread_join(pairs, least.select("u", F.least("u", "least").alias("least")), ["u"], "v", how="inner", merge=True)


def _towards_larger(pairs: DataFrame) -> DataFrame:
    both = _each(pairs, ("u", "v"), ("v", "u"))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _towards_smaller(pairs: DataFrame) -> DataFrame:
    return _each(_with_least(pairs), ("u", "least"), ("v", "least")).filter("u <> v").distinct()


def in_order(rows: DataFrame, order: list[str], kinds: str, start: Callable[[], Callable[[tuple], tuple | None]]) -> DataFrame:
    """Walks through the rows of each ``component`` in ``order``; each component lies in one task.

    ``start()`` gives a fresh function for a component, which gets its rows, as tuples of the columns, one after
    the other, and returns a row of the schema ``kinds`` or None. Rows are streamed: a task holds a batch of
    them and what the function remembers.
    """
    schema = to_arrow_schema(StructType.fromDDL(kinds))
    at = rows.columns.index("component")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, step = None, start()
        for batch in batches:
            out = []
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if row[at] != component:
                    component, step = row[at], start()
                if (result := step(row)) is not None:
                    out.append(result)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.repartition("component").sortWithinPartitions("component", *order).mapInArrow(run, kinds)
