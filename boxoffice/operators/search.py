"""Substring search over an index of trigrams.

The index holds, for each searched column, the ids of the rows by each three characters in a row of its folded text, in
buckets by the hash of these, and how many rows each has. A query is cut into its literal runs; the rows that have the rarest
trigrams of these are candidates, and the search itself then runs on the candidates only, so its answer
is that of a scan. A query without three literal characters in a row narrows nothing and scans.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxoffice.operators.spread import only_keys_of
from boxoffice.sources.layout import BUCKET, BUCKETS, bucket_of, read_buckets, touched, write_buckets

SIZE = 3
RAREST = 4  # trigrams of a query that are looked up; the others are left to the search on the candidates

# how the two kinds of search fold case
FOLDS = {"wildcard": F.lower, "literal": F.upper}
BREAKS = {"wildcard": re.compile(r"(?s:\\.)|[%_\\]"), "literal": re.compile(r"(?!)")}


def trigrams(text: Column) -> Column:
    """Each three characters in a row, once; NULL and shorter texts have none."""
    parts = F.transform(F.sequence(F.lit(1), F.length(text) - SIZE + 1), lambda i: F.substring(text, i, F.lit(SIZE)))
    return F.when(F.length(text) >= SIZE, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


@dataclass
class TrigramIndex:
    """Of ``columns`` of a table with the unique ``key``; ``kind`` is that of the search, "wildcard" or "literal"."""

    spark: SparkSession
    folder: str
    key: str
    key_type: str
    columns: tuple[str, ...]
    kind: str
    buckets: int = BUCKETS

    @classmethod
    def build(cls, rows: DataFrame, key: str, columns: Sequence[str], kind: str, folder: str, buckets: int = BUCKETS) -> TrigramIndex:
        index = cls(rows.sparkSession, folder, key, dict(rows.dtypes)[key], tuple(columns), kind, buckets)
        fold = FOLDS[kind]
        per_column = [rows.select(F.lit(n).alias("of"), F.explode(trigrams(fold(F.col(c)))).alias("gram"), key) for n, c in enumerate(columns)]
        postings = reduce(DataFrame.unionByName, per_column)
        write_buckets(postings.withColumn(BUCKET, bucket_of(F.col("gram"), buckets)), f"{folder}/postings")
        counts = index.postings().groupBy("of", "gram").agg(F.count("*").alias("n"))
        write_buckets(counts.withColumn(BUCKET, bucket_of(F.col("gram"), buckets)), f"{folder}/counts")
        return index

    def postings(self, buckets: list[int] | None = None) -> DataFrame:
        return read_buckets(self.spark, f"{self.folder}/postings", StructType.fromDDL(f"of int, gram string, {self.key} {self.key_type}"), buckets)

    def grams(self, query: str) -> list[str]:
        """The trigrams that a text must have to hold the query."""
        folded = self.spark.range(1).select(FOLDS[self.kind](F.lit(query.strip()))).first()[0]
        runs = BREAKS[self.kind].split(folded)
        return sorted({run[i : i + SIZE] for run in runs for i in range(len(run) - SIZE + 1)})

    def narrowed(self, rows: DataFrame, query: str | None) -> DataFrame:
        """The rows that may hold the query in one of the columns, among them all that do."""
        grams = self.grams(query or "")
        if not grams:
            return rows
        asked = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        buckets = touched(asked, "gram", "string", self.buckets)
        counts = read_buckets(self.spark, f"{self.folder}/counts", StructType.fromDDL("of int, gram string, n long"), buckets)
        sizes = {(r.of, r.gram): r.n for r in counts.filter(F.col("gram").isin(grams)).collect()}
        found = []
        for n in range(len(self.columns)):
            rarest = sorted(grams, key=lambda g: (sizes.get((n, g), 0), g))[:RAREST]
            if (n, rarest[0]) not in sizes:
                continue  # no row has it in this column
            few = touched(self.spark.createDataFrame([(g,) for g in rarest], "gram string"), "gram", "string", self.buckets)
            mine = self.postings(few).filter((F.col("of") == n) & F.col("gram").isin(rarest))
            found.append(mine.groupBy(self.key).agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select(self.key))
        if not found:
            return rows.limit(0)
        return only_keys_of(rows, reduce(DataFrame.unionByName, found), {self.key: self.key})
