"""Which intervals of days hold which days, by equality joins.

The whole line of days is cut into blocks of 1, 2, 4, .. days. An interval of n days is the union of at most about
2 * log2(n) blocks, no two of which meet, and a day lies in one block of each size. So day and interval meet in
exactly one block if the interval holds the day, and in none if it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 16  # the largest blocks have 2**16 days


def blocks_of(start: Column, end: Column, levels: int = LEVELS) -> Column:
    """The blocks (level, place) of the days from ``start`` to ``end``, both included; none if ``end`` is before."""
    first, after = F.unix_date(start).cast("long"), F.unix_date(end).cast("long") + 1

    def at(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.ceil(first / size), F.floor(after / size)
        odd = lambda n: F.pmod(n, F.lit(2)) == 1
        left = F.when((low < high) & odd(low), F.array(low))
        right = F.when((low + F.when(odd(low), 1).otherwise(0) < high) & odd(high), F.array(high - 1))
        top = F.when(low < high, F.sequence(low, high - 1))
        none = F.array().cast("array<bigint>")
        places = F.when(level == levels, F.coalesce(top, none)).otherwise(F.concat(F.coalesce(left, none), F.coalesce(right, none)))
        return F.transform(places, lambda p: F.struct(level.alias("level"), p.alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def with_intervals(days: DataFrame, day: str, intervals: DataFrame, start: str, end: str, levels: int = LEVELS) -> DataFrame:
    """The rows of ``days`` with each row of ``intervals`` whose days from ``start`` to ``end`` hold their ``day``.

    NULL days and ends meet nothing. Columns of the two must not have the same names. Only distinct days go through the
    blocks, so a day that has very many rows is one day there.
    """
    one = days.select(day).filter(F.col(day).isNotNull()).distinct()
    place = lambda level: F.floor(F.unix_date(F.col(day)) / F.call_function("shiftleft", F.lit(1).cast("long"), level))
    in_blocks = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), place(k).alias("place")))
    one = one.select(day, F.explode(in_blocks).alias("_block"))
    held = intervals.withColumn("_block", F.explode(blocks_of(F.col(start), F.col(end), levels)))
    return days.join(held.join(one, "_block").drop("_block"), day)
