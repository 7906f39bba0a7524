"""The table set that every operator takes as its first argument."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.operators.spread import only_keys_of
from boxoffice.schemas import TABLES

LISTED_KEYS = 1000

# Fixed value: the one table whose name is quoted in upper case in the database
DATABASE_NAMES = {"order": "ORDER"}


def database_name(schema: str, table: str) -> str:
    return f'{schema}."{DATABASE_NAMES.get(table, table)}"'


def uuid_ranges(column: str, parts: int) -> list[str]:
    """Conditions that cut a column of UUIDs into ranges of equal width; each row meets exactly one, NULL the first."""
    bounds = [str(uuid.UUID(int=(n << 128) // parts)) for n in range(1, parts)]
    low, high = [None, *bounds], [*bounds, None]
    ranges = []
    for a, b in zip(low, high, strict=True):
        ends = [f"{column} >= '{a}'" if a else "", f"{column} < '{b}'" if b else ""]
        ranges.append(" AND ".join(e for e in ends if e) or f"{column} IS NOT NULL")
    ranges[0] = f"({ranges[0]}) OR {column} IS NULL"
    return ranges


class Tables:
    """DataFrames by table name. A table may be given as a function, which is called on first use."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        unknown = set(frames) - set(TABLES)
        if unknown:
            raise KeyError(f"not a table of the model: {sorted(unknown)}")
        self.spark = spark
        self._frames = dict(frames)

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if callable(frame):
            frame = self._frames[name] = frame()
        return frame

    def __contains__(self, name: str) -> bool:
        return name in self._frames

    def __iter__(self):
        return iter(self._frames)

    def only(self, name: str, column: str, asked: DataFrame, theirs: str) -> DataFrame:
        """Rows of a table whose ``column`` has a value of ``asked.theirs``. Up to ``LISTED_KEYS`` distinct values become
        a filter that reaches the files, more a semi join."""
        listed = self._listed(name, column, asked, theirs)
        return only_keys_of(self[name], asked, {column: theirs}) if listed is None else listed

    def near(self, name: str, column: str, asked: DataFrame, theirs: str) -> DataFrame:
        """`only` for steps that join or count by ``column`` themselves: instead of a semi join, other rows stay."""
        listed = self._listed(name, column, asked, theirs)
        return self[name] if listed is None else listed

    def _listed(self, name: str, column: str, asked: DataFrame, theirs: str) -> DataFrame | None:
        keys = [r[0] for r in asked.select(theirs).filter(F.col(theirs).isNotNull()).distinct().limit(LISTED_KEYS + 1).collect()]
        return self[name].filter(F.col(column).isin(keys)) if len(keys) <= LISTED_KEYS else None

    def lookup(self, name: str, on: Mapping[str, str], asked: DataFrame) -> DataFrame:
        """Rows of a table whose columns have values of ``asked``; ``on`` maps columns of the table to those of ``asked``."""
        return only_keys_of(self[name], asked, on)

    def replace(self, **frames: DataFrame) -> "Tables":
        """A new table set in which the given tables take the place of the old ones."""
        return Tables(self.spark, {**self._frames, **frames})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Tables":
        """Parquet under ``folder/<table>``. The files carry the schema (``ticket.status`` is optional)."""
        return cls(spark, {name: (lambda n=name: spark.read.parquet(f"{folder}/{n}")) for name in TABLES})

    @classmethod
    def load_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        schema: str,
        splits: Mapping[str, Mapping[str, str]] | None = None,
        parts: Mapping[str, int] | None = None,
        **options: str,
    ) -> "Tables":
        """Tables of a database.

        ``parts`` holds, per large table, in how many ranges of its key, a UUID, it is read at once. ``splits`` holds the
        ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` of tables that are read by a number
        or date. A table without an entry is one task.
        """

        def read(name: str) -> DataFrame:
            table = database_name(schema, name)
            if name in (parts or {}):
                ranges = uuid_ranges(TABLES[name].key[0], parts[name])
                return spark.read.jdbc(url, table, predicates=ranges, properties=dict(options))
            reader = spark.read.format("jdbc").option("url", url).options(**options).option("dbtable", table)
            return reader.options(**(splits or {}).get(name, {})).load()

        return cls(spark, {name: (lambda n=name: read(n)) for name in TABLES})

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Mapping[str, Iterable[tuple]]) -> "Tables":
        """Inline rows, for tests and small fixtures."""
        return cls(
            spark,
            {name: spark.createDataFrame(list(data), TABLES[name].struct) for name, data in rows.items()},
        )

    def write(self, folder: str, names: Iterable[str] | None = None, mode: str = "errorifexists") -> None:
        for name in names or self._frames:
            self[name].write.mode(mode).parquet(f"{folder}/{name}")
