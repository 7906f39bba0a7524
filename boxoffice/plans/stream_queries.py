"""Stream queries: the events file as a stream, judged to its end; the ledger is the result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.plans.check_queries import redemptions, ticket_requests, verdicts
from boxoffice.plans.mapped import mapped_tables
from boxoffice.plans.registry import ORACLES, QUERIES
from boxoffice.session import shared_dir
from boxoffice.sources.layout import Layout, plus
from boxoffice.streaming import admission

BATCHES = 4


def _judged_stream(spark: SparkSession, sf_dir: str, requests, start, by: dict[str, str]) -> DataFrame:
    """The requests arrive in four parts in order of ``seq``, each of many files that are one micro-batch together.

    The tables lie in buckets by the keys that the stream asks for; ``event`` and its categories are small.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4()}"
    mapped = mapped_tables(spark, sf_dir)
    layout = Layout.create(mapped, f"{folder}/tables", by, by)
    t = layout.tables()
    whole = {name: mapped[name] for name in ("event", "ticket_category") if name not in by}

    rows = requests(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    place = F.least(F.floor((F.col("seq") - (low or 0)) * BATCHES / ((high or 0) - (low or 0) + 1)), F.lit(BATCHES - 1))
    rows.withColumn("place", place.cast("int")).write.partitionBy("place").parquet(f"{folder}/parts")
    parts = spark.read.schema(plus(rows.schema, "place", "int")).parquet(f"{folder}/parts")
    for n in range(BATCHES):
        parts.filter(F.col("place") == n).drop("place").write.mode("append").parquet(f"{folder}/requests")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/requests")
        start(stream, t.replace(**whole), folder).awaitTermination()
    return verdicts(admission.ledger(spark, folder), "seq")


TICKET_KEYS = {"ticket": "tcategory_id", "ticket_category": "category_id", "order": "order_id"}
PROMOTION_KEYS = {"promotion": "promotion_id", "order_promotion": "promotion_id", "order": "order_id", "ticket": "torder_id"}

QUERIES["t01_admit_tickets_stream"] = lambda spark, sf_dir: _judged_stream(
    spark, sf_dir, ticket_requests, admission.admit_tickets_stream, TICKET_KEYS
)
QUERIES["t02_admit_redemptions_stream"] = lambda spark, sf_dir: _judged_stream(
    spark, sf_dir, redemptions, admission.admit_redemptions_stream, PROMOTION_KEYS
)
ORACLES["t01_admit_tickets_stream"] = ORACLES["v07_admit_tickets"]
ORACLES["t02_admit_redemptions_stream"] = ORACLES["v05_admit_redemptions"]
