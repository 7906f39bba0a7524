"""Quota and promotion limits over a stream of requests.

Each micro-batch is judged by the same set-based checks as a table of candidates, against the tables as they
are when it runs: ``tables`` may be a function, which is called for every batch, so categories, orders and
promotions made since the stream began are known. Only rows with keys of the batch are read; tables that are laid
out by these keys (`sources.layout`) are read in the buckets of the batch alone.

What is kept between batches are the places taken per key, not the requests, in buckets by the hash of the key. A batch
reads and replaces the buckets of its keys, however large the state or long the stream. The tables
must not hold what the stream itself admitted. Each count of the state says which batch wrote it last and what it was
before, and the folder of a batch in the ledger is overwritten, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from boxoffice.operators.candidates import admit_under_limit, admit_under_quota, order_dates, promo_facts, quota_facts
from boxoffice.operators.spread import spread_join
from boxoffice.sources.layout import BUCKET, bucket_of, exists, plus, read_buckets, touched, write_buckets
from boxoffice.sources.tables import Tables

STATE_BUCKETS = 64


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """All judged requests of a stream so far, with the ``batch`` that judged them."""
    return spark.read.option("basePath", f"{folder}/ledger").parquet(f"{folder}/ledger")


class State:
    """Places taken per key, ``(key, taken, batch, before)`` in buckets: ``batch`` was the last to write the bucket and found ``before``."""

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str, buckets: int = STATE_BUCKETS):
        self.spark, self.path, self.key, self.kind, self.buckets = spark, f"{folder}/state", key, kind, buckets
        self.schema = StructType.fromDDL(f"{key} {kind}, taken long, batch long, before long")
        if not exists(spark, f"{self.path}/_SUCCESS"):
            write_buckets(spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0)), self.path, "overwrite")

    def touched(self, rows: DataFrame) -> list[int]:
        return touched(rows, self.key, self.kind, self.buckets)

    def read(self, buckets: list[int]) -> DataFrame:
        return read_buckets(self.spark, self.path, self.schema, buckets)

    def found_by(self, batch: int, buckets: list[int]) -> DataFrame:
        """``(key, taken)`` in the buckets, as the batch finds it even if it runs again."""
        found = F.when(F.col("batch") == batch, F.col("before")).otherwise(F.col("taken"))
        return self.read(buckets).select(self.key, found.alias("taken")).filter("taken > 0")

    def add(self, batch: int, buckets: list[int], added: DataFrame) -> None:
        """Replaces the buckets by what the batch found and what it adds, ``(key, added)``."""
        found = self.found_by(batch, buckets).withColumnRenamed("taken", "before")
        after = found.join(added, self.key, "full").select(
            self.key,
            (F.coalesce("before", F.lit(0)) + F.coalesce("added", F.lit(0))).alias("taken"),
            F.lit(batch).cast("long").alias("batch"),
            F.coalesce("before", F.lit(0)).cast("long").alias("before"),
        )
        write_buckets(after.withColumn(BUCKET, bucket_of(F.col(self.key), self.buckets)), self.path, "overwrite")


def _start(
    stream: DataFrame,
    tables: Tables | Callable[[], Tables],
    folder: str,
    key: str,
    judge: Callable[[Tables, DataFrame, DataFrame], DataFrame],
    options: dict,
) -> StreamingQuery:
    def on_batch(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        now = tables() if callable(tables) else tables
        target = f"{folder}/ledger/batch={batch}"
        requests.persist()
        try:
            state = State(spark, folder, key, requests.schema[key].dataType.simpleString())
            buckets = state.touched(requests)
            judge(now, requests, state.found_by(batch, buckets)).write.mode("overwrite").parquet(target)
        finally:
            requests.unpersist()
        admitted = spark.read.schema(plus(requests.schema, "accepted", "boolean")).parquet(target).filter("accepted")
        state.add(batch, buckets, admitted.groupBy(key).agg(F.count("*").alias("added")))

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{folder}/checkpoint")
    return writer.trigger(**(options or {"availableNow": True})).start()


def _plus_taken(facts: DataFrame, taken: DataFrame, key: str, column: str) -> DataFrame:
    total = F.col(column) + F.coalesce("taken", F.lit(0))
    return spread_join(facts, taken, [key]).withColumn(column, total).drop("taken")


def admit_tickets_stream(stream: DataFrame, tables: Tables | Callable[[], Tables], folder: str, **trigger) -> StreamingQuery:
    """Judges ticket requests (``seq, torder_id, tcategory_id, …``) as they arrive; see ``ledger``."""

    def judge(t: Tables, requests: DataFrame, taken: DataFrame) -> DataFrame:
        asked = t.replace(
            ticket=t.near("ticket", "tcategory_id", requests, "tcategory_id"),
            ticket_category=t.near("ticket_category", "category_id", requests, "tcategory_id"),
            order=t.near("order", "order_id", requests, "torder_id"),
        )
        facts = _plus_taken(quota_facts(asked, requests), taken, "tcategory_id", "_sold")
        return admit_under_quota(facts, asked["order"], requests)

    return _start(stream, tables, folder, "tcategory_id", judge, trigger)


def admit_redemptions_stream(stream: DataFrame, tables: Tables | Callable[[], Tables], folder: str, **trigger) -> StreamingQuery:
    """Judges promotion uses (``seq, promotion_id, order_id, …``) as they arrive; see ``ledger``."""

    def judge(t: Tables, requests: DataFrame, taken: DataFrame) -> DataFrame:
        asked = t.replace(
            promotion=t.near("promotion", "promotion_id", requests, "promotion_id"),
            order_promotion=t.near("order_promotion", "promotion_id", requests, "promotion_id"),
            order=t.near("order", "order_id", requests, "order_id"),
            ticket=t.near("ticket", "torder_id", requests, "order_id"),
        )
        facts = _plus_taken(promo_facts(asked, requests), taken, "promotion_id", "_used")
        return admit_under_limit(facts, order_dates(asked, requests), requests)

    return _start(stream, tables, folder, "promotion_id", judge, trigger)
