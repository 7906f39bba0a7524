"""Joins, ranks and totals that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_BITS = 20


def spread_join(
    left: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    row_id: str | None = None,
    how: str = "left",
    salts: int = 1,
    merge: bool = False,
) -> DataFrame:
    """Join ``left``, in which one key may hold very many rows, to ``facts`` with one row per key.

    The adaptive skew-join rule cuts an oversized partition of ``left`` and reads the matching partition
    of ``facts`` once per piece, but only where a shuffle lies directly under both sides of the join.
    Facts are mostly aggregates, whose own shuffle is below the aggregate and already on the key. The
    salt column adds to the join key and so puts a fresh shuffle on top of both sides. Rows with a NULL
    key are cut the same way, and small facts still become a broadcast by their true size.

    ``salts`` above one cuts every key into that many parts by ``row_id`` up front, at the price of as
    many copies of the facts. It is meant for sessions that run without adaptive execution.

    ``merge`` is for facts that grow with the input: Spark estimates them from files or rows that may be
    far smaller than what they become, and with its usual bound would build them on the driver.
    """
    salt = "_salt"
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(row_id or on[0]), F.lit(salts)).cast("int"))
    copies = facts.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint("merge") if merge else copies, on=[*on, salt], how=how).drop(salt)


def running_counts(
    df: DataFrame,
    keys: Sequence[str],
    flags: Mapping[str, Column],
    seq: str = "seq",
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Per row, the number of rows of the same key with a smaller ``seq`` for which the flag holds.

    ``seq`` is a unique long. A window per key would sort a whole hot key in one task, so rows are
    counted inside blocks of 2**bits sequence numbers, and the counts of the blocks before come from
    two more levels of the same kind. No window group on any level exceeds 2**bits rows (2**(63-2*bits)
    on the top level), whatever share of the rows a key holds. Rows with a NULL key stay, but their
    counts mean nothing.
    """
    block, span = "_block", "_span"
    flagged = df.select("*", *[F.coalesce(c, F.lit(False)).cast("long").alias(f"_f_{n}") for n, c in flags.items()])
    flagged = flagged.withColumn(block, F.shiftright(F.col(seq).cast("long"), bits))

    per_block = (
        flagged.groupBy(*keys, block)
        .agg(*[F.sum(f"_f_{n}").alias(n) for n in flags])
        .withColumn(span, F.shiftright(block, bits))
    )
    before_in_span = Window.partitionBy(*keys, span).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = per_block.select(
        *keys, block, span, *[F.coalesce(F.sum(n).over(before_in_span), F.lit(0)).alias(f"_b_{n}") for n in flags]
    )
    per_span = per_block.groupBy(*keys, span).agg(*[F.sum(n).alias(n) for n in flags])
    before = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    spans = per_span.select(
        *keys, span, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_s_{n}") for n in flags]
    )
    offsets = blocks.join(spans, [*keys, span]).select(
        *keys, block, *[(F.col(f"_b_{n}") + F.col(f"_s_{n}")).alias(f"_o_{n}") for n in flags]
    )

    in_block = Window.partitionBy(*keys, block).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    counted = flagged.select(
        *df.columns,
        block,
        *[F.coalesce(F.sum(f"_f_{n}").over(in_block), F.lit(0)).alias(f"_n_{n}") for n in flags],
    )
    return counted.join(offsets, [*keys, block], "left").select(
        *df.columns, *[(F.col(f"_n_{n}") + F.coalesce(f"_o_{n}", F.lit(0))).alias(n) for n in flags]
    )


def only_keys_of(df: DataFrame, asked: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``asked``; ``on`` maps columns of ``df`` to columns of ``asked``."""
    keys = asked.select(*[F.col(theirs).alias(ours) for ours, theirs in on.items()]).distinct()
    return spread_join(df, keys, list(on), how="left_semi").select(*df.columns)


def without_keys_of(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``keys``."""
    return spread_join(df, keys.select(*on).distinct(), on, how="left_anti").select(*df.columns)


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` (from 1) says, in place. In two steps, so that no list of a row has more than 2**16 entries."""
    most = F.lit(1 << 16)
    cut = df.withColumn("_times", times.cast("long")).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("_times") - 1, 16))))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.least(most, F.col("_times") - F.col("_part") * most)))
    return cut.withColumn("_one", one).select(*df.columns)


def side_by_side(*totals: DataFrame) -> DataFrame:
    """One row out of several one-row totals with different columns."""
    rows = totals[0]
    for total in totals[1:]:
        rows = rows.unionByName(total, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])
