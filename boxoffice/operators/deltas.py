"""What a change set does to some rows, without a look at the others."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.operators.spread import only_keys_of, spread_join, without_keys_of
from boxoffice.schemas import TABLES
from boxoffice.sources.tables import Tables


def touched_keys(change, table: str) -> DataFrame:
    """The first key column of the rows that go, come or change."""
    return change.rewrites[table].keys.select(TABLES[table].key[0]).distinct()


def rows_after(t: Tables, change, table: str, on: Mapping[str, str], asked: DataFrame) -> DataFrame:
    """`Tables.lookup` as it will be after the change set. Of the old table, the asked and the touched rows are read."""
    found = t.lookup(table, on, asked)
    if table not in change.rewrites:
        return found
    key, keys = TABLES[table].key[0], touched_keys(change, table)
    old = without_keys_of(found, keys, [key]).unionByName(t.lookup(table, {key: key}, keys))
    return only_keys_of(change.rewrites[table].apply(old), asked, on)


def touched_rows(t: Tables, change, table: str) -> tuple[DataFrame, DataFrame]:
    """The rows that the change set touches, as they are and as they will be. Only they are read."""
    before = t.lookup(table, {TABLES[table].key[0]: TABLES[table].key[0]}, touched_keys(change, table))
    return before, change.rewrites[table].apply(before)


@dataclass
class Kept:
    """A stored aggregate: rows, sums, least and greatest values (each an SQL expression) of groups; ``keys`` may be empty."""

    keys: Sequence[str]
    sums: Mapping[str, str] = field(default_factory=dict)
    least: Mapping[str, str] = field(default_factory=dict)
    most: Mapping[str, str] = field(default_factory=dict)

    def of(self, rows: DataFrame) -> DataFrame:
        """The aggregate of all rows: keys, ``rows``, and the figures. Groups without rows are not there."""
        sums = [F.coalesce(F.sum(F.expr(c)), F.lit(0)).alias(n) for n, c in self.sums.items()]
        ends = [F.min(F.expr(c)).alias(n) for n, c in self.least.items()] + [F.max(F.expr(c)).alias(n) for n, c in self.most.items()]
        return rows.groupBy(*self.keys).agg(F.count("*").alias("rows"), *sums, *ends).filter("rows > 0")

    def after(self, stored: DataFrame, gone: DataFrame, come: DataFrame, whole: DataFrame | None = None) -> DataFrame:
        """The aggregate after rows are ``gone`` and others ``come``; a row in both changes nothing.

        A group is only aggregated anew, from ``whole``, the rows after the change, if it loses a least or
        greatest value and gets none as good. Without least and greatest values ``whole`` is not needed.
        """
        return self.moved(stored, gone.withColumn("_sign", F.lit(-1)).unionByName(come.withColumn("_sign", F.lit(1))), whole)

    def moved(self, stored: DataFrame, signed: DataFrame, whole: DataFrame | None = None) -> DataFrame:
        """`after` with rows that come (or go, below zero) as often as ``_sign`` says."""
        sums = [F.sum(F.col("_sign") * F.expr(c)).alias(f"_d_{n}") for n, c in self.sums.items()]
        ends = []
        for extreme, figures in ((F.min, self.least), (F.max, self.most)):
            for n, c in figures.items():
                ends += [extreme(F.when(F.col("_sign") < 0, F.expr(c))).alias(f"_lost_{n}"), extreme(F.when(F.col("_sign") > 0, F.expr(c))).alias(f"_won_{n}")]
        delta = signed.groupBy(*self.keys).agg(F.sum("_sign").alias("_d_rows"), *sums, *ends)
        packed = F.struct(*self.keys, F.lit(0).alias("_all"))  # groups with a NULL in the key meet, too
        old = stored.select(packed.alias("_g"), *[c for c in stored.columns if c not in self.keys])
        new = delta.select(packed.alias("_g"), *[c for c in delta.columns if c not in self.keys])
        both = old.join(new, "_g", "full")
        types = dict(stored.dtypes)
        moved = lambda n: (F.coalesce(n, F.lit(0)) + F.coalesce(f"_d_{n}", F.lit(0))).cast(types[n]).alias(n)
        again, figures = F.lit(False), []
        for better, names in ((F.least, self.least), (F.greatest, self.most)):
            for n in names:
                lost, won = F.col(f"_lost_{n}"), F.col(f"_won_{n}")
                again = again | F.coalesce((better(lost, n) == lost) & (won.isNull() | (better(won, n) != won)), F.lit(False))
                figures.append(better(n, won).alias(n))
        after = both.select("_g", moved("rows"), *[moved(n) for n in self.sums], *figures, again.alias("_again")).filter("rows > 0")
        columns = [*[F.col(f"_g.{k}").alias(k) for k in self.keys], "rows", *self.sums, *self.least, *self.most]
        kept = after.filter("NOT _again").select(*columns)
        if whole is None:
            return kept
        lost = after.filter("_again").select("_g")
        part = spread_join(whole.withColumn("_g", packed), lost, ["_g"], how="left_semi").drop("_g")
        return kept.unionByName(self.of(part).select(*kept.columns))
