import random
import uuid
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import candidates
from boxoffice.session import shared_dir
from boxoffice.sources import tables
from boxoffice.sources.layout import Layout
from boxoffice.streaming import admission
from tests.test_checks import quota_shop, small


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4()}"


def feed(spark, rows, schema, folder, files):
    """Requests cut into files in order of arrival; one file is one micro-batch."""
    size = -(-len(rows) // files)
    for n in range(files):
        spark.createDataFrame(rows[n * size : (n + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def verdicts(df):
    return {r.seq: r.reason for r in df.select("seq", "reason").collect()}


def test_tickets_over_batches_equal_one_table(spark, folder):
    rng = random.Random(21)
    shop, _, _ = quota_shop(spark, rng)
    rows = [(n, f"o{rng.randrange(10)}", f"c{rng.choice([0, 1, 2, 5, 5, 6])}") for n in range(60)]
    schema = "seq long, torder_id string, tcategory_id string"
    stream = feed(spark, rows, schema, f"{folder}/in", 5)
    admission.admit_tickets_stream(stream, shop, folder).awaitTermination()
    done = admission.ledger(spark, folder)
    assert done.select("batch").distinct().count() == 5
    assert verdicts(done) == verdicts(candidates.admit_tickets(shop, spark.createDataFrame(rows, schema)))

    more = [(n, "o1", "c4") for n in range(60, 75)]
    stream = feed(spark, more, schema, f"{folder}/in", 1)
    admission.admit_tickets_stream(stream, shop, folder).awaitTermination()
    expected = verdicts(candidates.admit_tickets(shop, spark.createDataFrame(rows + more, schema)))
    assert verdicts(admission.ledger(spark, folder)) == expected, "a restart goes on where the stream stopped"


def test_a_batch_that_runs_again_changes_nothing(spark, folder):
    rng = random.Random(22)
    shop, _, _ = quota_shop(spark, rng)
    schema = "seq long, torder_id string, tcategory_id string"
    rows = [(n, "o1", f"c{rng.randrange(6)}") for n in range(40)]
    calls = []

    class Twice:
        """Hands each batch over twice, as after a failure before the commit."""

        def __init__(self, stream):
            self.stream = stream

        @property
        def writeStream(self):  # noqa: N802
            writer = self.stream.writeStream
            plain = writer.foreachBatch

            def doubled(function):
                def run(df, batch):
                    calls.append(batch)
                    function(df, batch)
                    function(df, batch)

                return plain(run)

            writer.foreachBatch = doubled
            return writer

    stream = Twice(feed(spark, rows, schema, f"{folder}/in", 2))
    admission.admit_tickets_stream(stream, shop, folder).awaitTermination()
    assert calls == [0, 1]
    done = admission.ledger(spark, folder)
    assert done.count() == 40
    assert verdicts(done) == verdicts(candidates.admit_tickets(shop, spark.createDataFrame(rows, schema)))


def test_redemptions_over_batches(spark, folder):
    at = lambda d: datetime(2026, 1, d, 20)
    shop = small(
        spark,
        promotion=[("p0", "A", "NOMINAL", Decimal(1), at(1).date(), at(10).date(), 4), ("p1", "B", "NOMINAL", Decimal(1), at(1).date(), at(31).date(), 9)],
        order=[(f"o{n}", at(1), "LUNAS", Decimal(0), "x") for n in range(5)],
        event=[("e0", at(5), "t", "v", "g"), ("e1", at(20), "t", "v", "g")],
        ticket_category=[("c0", "n", 9, Decimal(1), "e0"), ("c1", "n", 9, Decimal(1), "e1")],
        ticket=[(f"k{n}", f"k{n}", f"c{n % 2}", f"o{n}") for n in range(4)],
        order_promotion=[("u", "p0", "o0")],
    )
    rng = random.Random(23)
    rows = [(n, f"p{rng.randrange(3)}", f"o{rng.randrange(6)}") for n in range(40)]
    schema = "seq long, promotion_id string, order_id string"
    stream = feed(spark, rows, schema, f"{folder}/in", 4)
    admission.admit_redemptions_stream(stream, shop, folder).awaitTermination()
    done = admission.ledger(spark, folder)
    assert verdicts(done) == verdicts(candidates.admit_redemptions(shop, spark.createDataFrame(rows, schema)))
    assert done.filter(F.col("accepted")).groupBy("promotion_id").count().filter("count > 9").isEmpty()


@pytest.mark.parametrize("listed", [1000, 0])
def test_tables_may_change_between_batches(spark, folder, monkeypatch, listed):
    monkeypatch.setattr(tables, "LISTED_KEYS", listed)
    shop, _, _ = quota_shop(spark, random.Random(24))
    schema = "seq long, torder_id string, tcategory_id string"
    now = [shop]

    def run(rows):
        stream = feed(spark, rows, schema, f"{folder}/in", 1)
        admission.admit_tickets_stream(stream, lambda: now[0], folder).awaitTermination()
        return verdicts(admission.ledger(spark, folder))

    first = run([(1, "o1", "new"), (2, "late", "c4")])
    assert first[1] == "unknown_category" and first[2] in ("unknown_order", "quota_full")
    category = spark.createDataFrame([("new", "New", 2, Decimal(1), "e")], shop["ticket_category"].schema)
    order = spark.createDataFrame([("late", datetime(2026, 1, 1), "LUNAS", Decimal(0), "x")], shop["order"].schema)
    now[0] = shop.replace(ticket_category=shop["ticket_category"].unionByName(category), order=shop["order"].unionByName(order))
    second = run([(3, "late", "new"), (4, "o1", "new"), (5, "o2", "new"), (6, None, None)])
    assert (second[3], second[4], second[5], second[6]) == (None, None, "quota_full", "unknown_category")


def test_a_batch_reads_its_buckets_only(spark, folder, monkeypatch):
    """The state and the tables grow tenfold; a batch of one category reads as many files as before."""
    schema = "seq long, torder_id string, tcategory_id string"
    at = datetime(2026, 1, 1)
    shop = small(
        spark,
        ticket_category=[(f"c{n}", "n", 3, Decimal(1), "e") for n in range(2000)],
        order=[(f"o{n}", at, "LUNAS", Decimal(0), "x") for n in range(2000)],
        ticket=[(f"k{n}", f"k{n}", f"c{n}", f"o{n}") for n in range(2000)],
    )
    by = {"ticket": "tcategory_id", "ticket_category": "category_id", "order": "order_id"}
    laid = Layout.create(shop, f"{folder}/tables", by, by, buckets=16).tables()
    read = []
    original = admission.State.read
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    monkeypatch.setattr(admission.State, "read", lambda self, buckets: (read.append(files(original(self, buckets))), original(self, buckets))[1])
    rows = []
    for low, high in ((0, 40), (40, 41), (41, 1600), (1600, 1601), (1601, 1602)):
        rows += [(n, f"o{n}", "c7" if high - low == 1 else f"c{n}") for n in range(low, high)]
        stream = feed(spark, rows[low:high], schema, f"{folder}/in", 1)
        admission.admit_tickets_stream(stream, laid, folder).awaitTermination()
    small_batches = [read[2 * n : 2 * n + 2] for n in (1, 3, 4)]
    assert len(read) == 10 and all(n <= 1 for pair in small_batches for n in pair)
    assert max(read[4:6]) > 10
    done = admission.ledger(spark, folder)
    assert verdicts(done) == verdicts(candidates.admit_tickets(shop, spark.createDataFrame(rows, schema)))
    # of the tables, a request reads the bucket of its category
    one = spark.createDataFrame([(1, "o1", "c7")], schema)
    layout = laid.layout
    assert files(layout.rows("ticket")) >= 16 and files(layout.rows("ticket", layout.touched("ticket", one))) == 1
    assert laid.only("ticket", "tcategory_id", one, "tcategory_id").count() == 1


def test_a_batch_meets_its_tables_once(spark, folder):
    """Steps that join or count by the key get the rows of its buckets, without a semi join before."""
    schema = "seq long, torder_id string, tcategory_id string"
    shop = small(spark, ticket=[(f"k{n}", f"k{n}", f"c{n}", f"o{n}") for n in range(2000)])
    laid = Layout.create(shop, f"{folder}/tables", ["ticket"], {"ticket": "tcategory_id"}, buckets=16).tables()
    one = spark.createDataFrame([(1, "o1", "c7")], schema)
    many = spark.createDataFrame([(n, f"o{n}", f"c{n}") for n in range(1900)], schema)
    for t in (laid, shop):
        rows = t.near("ticket", "tcategory_id", many, "tcategory_id")
        assert rows.count() >= 1900 and "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert shop.near("ticket", "tcategory_id", one, "tcategory_id").count() == 1
    assert 1 <= laid.near("ticket", "tcategory_id", one, "tcategory_id").count() < 400
