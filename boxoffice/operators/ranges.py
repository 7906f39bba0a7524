"""Exact positions inside keys of any size, for any order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.session import staged


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """Adds ``position`` (from 1) of each row inside its key.

    The rows are range-partitioned by key and order, so a hot key is cut into several ranges; ``order``
    must end in a unique column. The range number is written down once, because the
    bounds are sampled and the two uses below must agree on them. A position is then the row's place in
    its range plus the sizes of the key's ranges before it.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(ranges, *[F.asc(k) for k in keys], *order)
    ranged = staged(ranged.withColumn("_range", F.spark_partition_id()), "ranges")

    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    placed = ranged.withColumn("_place", F.row_number().over(inside))
    return placed.join(starts, [*keys, "_range"]).select(
        *df.columns, (F.col("_place") + F.col("_start")).alias("position")
    )
