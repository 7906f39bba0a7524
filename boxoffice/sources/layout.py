"""Tables in folders by the hash of a key, so that work on a few keys reads and replaces a few folders.

A table lies in ``folder/<table>/_bucket=<n>``. A change set rewrites the buckets of the keys that it touches, by
Spark's dynamic partition overwrite; the files of all other buckets stay as they are. A change set has a name
and is applied once: what it is going to write, what it refuses and the ids that it gives are first written beside the tables,
so a run that fails between two tables is finished by the next, and a run of a finished change set changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxoffice.operators.spread import only_keys_of
from boxoffice.schemas import TABLES
from boxoffice.sources.tables import Tables

BUCKETS = 64
BUCKET = "_bucket"


def bucket_of(column: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int").alias(BUCKET)


def plus(schema: StructType, name: str, kind: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(f"{name} {kind}").fields])


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _file_system(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


def write_buckets(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``df`` has the column ``_bucket``. Buckets of more than a partition's size are cut into several files."""
    dealt = df.hint("rebalance", F.col(BUCKET))
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: StructType, buckets: Iterable[int] | None = None) -> DataFrame:
    """Only the folders of ``buckets`` are read, and ``_bucket`` is left out."""
    rows = spark.read.schema(plus(schema, BUCKET, "int")).parquet(path)
    if buckets is not None:
        rows = rows.filter(F.col(BUCKET).isin(sorted(buckets)))
    return rows.drop(BUCKET)


def touched(keys: DataFrame, column: str, kind: str, buckets: int) -> list[int]:
    """The buckets of the keys, at most ``buckets`` numbers."""
    return sorted(keys.agg(F.collect_set(bucket_of(F.col(column).cast(kind), buckets))).first()[0])


@dataclass
class Applied:
    """What a change set refused, and the ids of the rows it added (None where it gives none)."""

    rejects: DataFrame
    ids: DataFrame | None


class Layout:
    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, Mapping]):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.by = {name: spec["by"] for name, spec in tables.items()}
        self.buckets = {name: spec["buckets"] for name, spec in tables.items()}
        self.schemas = {name: StructType.fromJson(spec["schema"]) for name, spec in tables.items()}

    @classmethod
    def create(cls, t: Tables, folder: str, names: Iterable[str] | None = None, by: Mapping[str, str] | None = None, buckets: int = BUCKETS) -> Layout:
        """Lays tables out by the first column of their key, or by that of ``by``."""
        specs = {}
        for name in names or list(t):
            column = (by or {}).get(name, TABLES[name].key[0])
            specs[name] = {"by": column, "buckets": buckets, "schema": t[name].schema.jsonValue()}
            write_buckets(t[name].withColumn(BUCKET, bucket_of(F.col(column), buckets)), f"{folder}/{name}")
        note = [(name, json.dumps(spec)) for name, spec in specs.items()]
        t.spark.createDataFrame(note, "name string, spec string").coalesce(1).write.parquet(f"{folder}/layout")
        return cls(t.spark, folder, specs)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Layout:
        return cls(spark, folder, {r.name: json.loads(r.spec) for r in spark.read.parquet(f"{folder}/layout").collect()})

    def rows(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        return read_buckets(self.spark, f"{self.folder}/{name}", self.schemas[name], buckets)

    def kind(self, name: str) -> str:
        return self.schemas[name][self.by[name]].dataType.simpleString()

    def touched(self, name: str, keys: DataFrame) -> list[int]:
        if self.by[name] not in keys.columns:
            raise ValueError(f"{name} is laid out by {self.by[name]}, but the change names rows by {', '.join(keys.columns)}")
        return touched(keys, self.by[name], self.kind(name), self.buckets[name])

    def tables(self) -> LaidOut:
        """The tables as they are now; after a change set is applied, ask again."""
        return LaidOut(self)

    def apply(self, change, batch: str) -> Applied:
        """Writes the touched buckets of a `ChangeSet`; ``batch`` is its name."""
        log = f"{self.folder}/changes/{batch}"
        if not exists(self.spark, f"{log}/done"):
            if not exists(self.spark, f"{log}/plan/_SUCCESS"):
                remove(self.spark, log)
                self._prepare(change, log)
            for row in self.spark.read.parquet(f"{log}/plan").orderBy("name").collect():
                self._replace(row.name, row.buckets, f"{log}/tables/{row.name}")
            self._finish(log)
        ids = f"{log}/ids"
        return Applied(self.spark.read.parquet(f"{log}/rejects"), self.spark.read.parquet(ids) if exists(self.spark, ids) else None)

    def _prepare(self, change, log: str) -> None:
        plan = []
        for name, rewrite in change.rewrites.items():
            buckets = self.touched(name, rewrite.keys)
            new = rewrite.apply(self.rows(name, buckets)).select(*self.schemas[name].names)
            write_buckets(new.withColumn(BUCKET, bucket_of(F.col(self.by[name]), self.buckets[name])), f"{log}/tables/{name}")
            plan.append((name, buckets))
        change.rejects.write.parquet(f"{log}/rejects")
        if change.ids is not None:
            change.ids.write.parquet(f"{log}/ids")
        self.spark.createDataFrame(plan, "name string, buckets array<int>").coalesce(1).write.parquet(f"{log}/plan")

    def _replace(self, name: str, buckets: list[int], source: str) -> None:
        new = self.spark.read.schema(plus(self.schemas[name], BUCKET, "int")).parquet(source)
        write_buckets(new, f"{self.folder}/{name}", "overwrite")
        for bucket in buckets:  # a bucket that has lost all its rows
            if not exists(self.spark, f"{source}/{BUCKET}={bucket}"):
                remove(self.spark, f"{self.folder}/{name}/{BUCKET}={bucket}")

    def _finish(self, log: str) -> None:
        self.spark.createDataFrame([(True,)], "done boolean").coalesce(1).write.mode("overwrite").parquet(f"{log}/done")
        remove(self.spark, f"{log}/tables")


class LaidOut(Tables):
    """The tables of a layout."""

    def __init__(self, layout: Layout, frames: Mapping[str, DataFrame] | None = None):
        laid_out = {name: (lambda n=name: layout.rows(n)) for name in layout.by}
        super().__init__(layout.spark, {**laid_out, **(frames or {})})
        self.layout, self.others = layout, dict(frames or {})

    def replace(self, **frames: DataFrame) -> LaidOut:
        return LaidOut(self.layout, {**self.others, **frames})

    def only(self, name: str, column: str, asked: DataFrame, theirs: str) -> DataFrame:
        if name in self.others or self.layout.by[name] != column:
            return super().only(name, column, asked, theirs)
        return self.lookup(name, {column: theirs}, asked)

    def near(self, name: str, column: str, asked: DataFrame, theirs: str) -> DataFrame:
        if name in self.others or self.layout.by[name] != column:
            return super().near(name, column, asked, theirs)
        return self.layout.rows(name, self.layout.touched(name, asked.select(F.col(theirs).alias(column))))

    def lookup(self, name: str, on: Mapping[str, str], asked: DataFrame) -> DataFrame:
        """Of a table that is laid out by one of the columns, the buckets of the asked values are read."""
        column = self.layout.by.get(name)
        if name in self.others or column not in on:
            return super().lookup(name, on, asked)
        buckets = self.layout.touched(name, asked.select(F.col(on[column]).alias(column)))
        return only_keys_of(self.layout.rows(name, buckets), asked, on)
