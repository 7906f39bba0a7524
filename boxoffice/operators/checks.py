"""Table-wide checks read from the table specs: nulls, lengths, value rules, keys, references."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.operators.deltas import rows_after, touched_keys
from boxoffice.operators.spread import without_keys_of
from boxoffice.schemas import TABLES, Reference, references_to
from boxoffice.sources.tables import Tables

# Rows that a task counts, and parts of a value that very many rows have.
TASK_ROWS, HOT_PARTS = 300_000, 8


def judged(df: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds ``accepted`` and ``reason``; the first rule that holds gives the reason."""
    reason = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())


def null_violations(table: str, present: Sequence[str]) -> list[Column]:
    required = [c.name for c in TABLES[table].columns if not c.nullable and c.name in present]
    return [F.when(F.col(n).isNull(), F.lit(f"null:{n}")) for n in required]


def length_violations(table: str, present: Sequence[str]) -> list[Column]:
    spec = TABLES[table]
    limited = [c for c in (*spec.columns, *spec.optional) if c.length and c.name in present]
    return [F.when(F.length(c.name) > c.length, F.lit(f"length:{c.name}")) for c in limited]


def rule_violations(table: str, present: Sequence[str]) -> list[Column]:
    """A rule that comes out NULL passes, as a CHECK constraint does; one whose column is not there is left
    out. Every rule of the model begins with the one column that it reads."""
    return [
        F.when(~F.coalesce(F.expr(rule), F.lit(True)), F.lit(f"check:{name}"))
        for name, rule in TABLES[table].rules.items()
        if rule.split()[0] in present
    ]


def with_violations(df: DataFrame, violations: Sequence[Column]) -> DataFrame:
    """Adds ``reason`` (all violations of the row, by comma) and ``accepted``. No shuffle."""
    reason = F.concat_ws(",", *violations) if violations else F.lit("")
    return df.withColumn("reason", F.nullif(reason, F.lit(""))).withColumn("accepted", F.col("reason").isNull())


def check_not_null(df: DataFrame, table: str) -> DataFrame:
    return with_violations(df, null_violations(table, df.columns))


def check_lengths(df: DataFrame, table: str) -> DataFrame:
    return with_violations(df, length_violations(table, df.columns))


def check_rules(df: DataFrame, table: str) -> DataFrame:
    return with_violations(df, rule_violations(table, df.columns))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows. NULL keys never collide."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.filter(known).groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def check_keys(t: Tables, table: str) -> DataFrame:
    """Broken primary and unique keys of a table: constraint, key as text, number of rows."""
    spec = TABLES[table]
    found = []
    for kind, keys in [("key", spec.key), *[("unique", u) for u in spec.unique]]:
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        name = F.lit(f"{kind}:{table}({', '.join(keys)})")
        found.append(check_unique(t[table], keys).select(name.alias("constraint"), text.alias("key"), "rows"))
    return reduce(DataFrame.unionByName, found)


def orphans(t: Tables, table: str, ref: Reference, tasks: int = 1) -> DataFrame:
    """Values of a reference that the parent does not have.

    Rows are counted in ``tasks`` parts of the values, and a value that very many rows have in several of them; then
    counts and parents meet value by value. Nothing is sorted.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(HOT_PARTS)).alias("_salt")
    values = t[table].select(F.col(ref.column).alias("key"), salt).filter("key IS NOT NULL")
    counted = values.repartition(tasks, "key", "_salt").groupBy("key", "_salt").agg(F.count("*").alias("rows"))
    parents = t[ref.parent].select(F.col(ref.parent_column).alias("key"), F.lit(None).cast("long").alias("rows")).filter("key IS NOT NULL")
    met = counted.drop("_salt").unionByName(parents).repartition(tasks, "key").groupBy("key")
    missing = met.agg(F.sum("rows").alias("rows"), F.count("rows").alias("_counts"), F.count("*").alias("_all")).filter("_counts = _all")
    name = f"reference:{table}({ref.column}) to {ref.parent}"
    return missing.select(F.lit(name).alias("constraint"), F.col("key").cast("string").alias("key"), "rows")


def check_foreign_keys(t: Tables, table: str | None = None) -> DataFrame:
    """Broken references of one table, or all 17 of the model. Tables are counted first, so that a task gets a bounded
    number of their rows."""
    names = [table] if table else list(TABLES)
    wanted = [(name, ref) for name in names for ref in TABLES[name].references]
    if not wanted:
        return t.spark.createDataFrame([], "constraint string, key string, rows long")
    sizes = {name: t[name].count() for name in {x for name, ref in wanted for x in (name, ref.parent)}}
    found = [orphans(t, name, ref, 1 + (sizes[name] + sizes[ref.parent]) // TASK_ROWS) for name, ref in wanted]
    return reduce(DataFrame.unionByName, found)


def check_changes(t: Tables, change) -> DataFrame:
    """Keys and references that a change set breaks: what `check_keys` and `check_foreign_keys` find in the tables after it,
    if they find nothing in ``t``.

    Looked at are the rows that the change set touches, and of others those with the same unique values, the
    parents of the new rows, and the children of parents that go.
    """
    found = [t.spark.createDataFrame([], "constraint string, key string, rows long")]
    for table in change.rewrites:
        spec, key = TABLES[table], TABLES[table].key[0]
        asked = touched_keys(change, table)
        new = rows_after(t, change, table, {key: key}, asked)
        for kind, keys in [("key", spec.key), *[("unique", u) for u in spec.unique]]:
            same = rows_after(t, change, table, {k: k for k in keys}, new.select(*keys).distinct())
            name, text = f"{kind}:{table}({', '.join(keys)})", F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
            found.append(check_unique(same, keys).select(F.lit(name).alias("constraint"), text.alias("key"), "rows"))
        for ref in spec.references:
            values = new.filter(F.col(ref.column).isNotNull()).select(F.col(ref.column).alias("key")).distinct()
            found.append(_orphans_after(t, change, table, ref, values))
        for child, ref in references_to(table):
            was = t.lookup(table, {key: key}, asked).select(F.col(ref.parent_column).alias("key")).distinct()
            gone = without_keys_of(was, new.select(F.col(ref.parent_column).alias("key")), ["key"])
            found.append(_orphans_after(t, change, child.name, ref, gone))
    return reduce(DataFrame.unionByName, found).distinct()


def _orphans_after(t: Tables, change, table: str, ref: Reference, values: DataFrame) -> DataFrame:
    """Which of the ``key`` values no parent has after the change set, and how many rows refer to them."""
    parents = rows_after(t, change, ref.parent, {ref.parent_column: "key"}, values)
    missing = without_keys_of(values, parents.select(F.col(ref.parent_column).alias("key")), ["key"])
    rows = rows_after(t, change, table, {ref.column: "key"}, missing).groupBy(F.col(ref.column).alias("key")).agg(F.count("*").alias("rows"))
    name = f"reference:{table}({ref.column}) to {ref.parent}"
    return rows.select(F.lit(name).alias("constraint"), F.col("key").cast("string").alias("key"), "rows")
