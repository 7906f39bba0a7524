"""Search by trigrams and intervals by day against scans and loops; one-pass reports; ranges of database keys."""

import random
import uuid
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameReader

from boxoffice.functions.columns import literal_match, wildcard_match
from boxoffice.operators import events, orders, tickets
from boxoffice.operators.intervals import blocks_of, with_intervals
from boxoffice.operators.search import TrigramIndex
from boxoffice.session import shared_dir
from boxoffice.sources.tables import Tables, uuid_ranges

QUERIES = ["river", "RIV", "iver s", "straße", "STRASSE", "ΑΣ", "ας", "éla", "ÉLAN", "x%y", "50%_off", "a_c", "%", "ab", "", None, "no such text", "İst", "ri%er%st", "\\%", "ver\\_s", "日本語", " river "]
TITLES = ["River song", "DRIVER STAGE", "Große Straße", "ΑΣ ΟΔΟΣ", "élan vital", "ELAN", "x%y and z", "50%_off", "abc", "aXc", "İstanbul", "ver_s", "日本語の歌", "", None, "ab", "a river stone", "Elan ÉLAN", "river\\%", "rivers_stone"]


@pytest.mark.parametrize("kind, match", [("wildcard", wildcard_match), ("literal", literal_match)])
def test_index_and_scan_find_the_same(spark, kind, match):
    rng = random.Random(1)
    rows = [(n, rng.choice(TITLES), rng.choice(TITLES)) for n in range(120)]
    df = spark.createDataFrame(rows, "id long, title string, other string")
    index = TrigramIndex.build(df, "id", ["title", "other"], kind, f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}", buckets=8)
    narrowed = 0
    for q in QUERIES:
        condition = match(q, "title", "other")
        scan = df if condition is None else df.filter(condition)
        few = index.narrowed(df, q)
        found = few if condition is None else few.filter(condition)
        assert sorted(r.id for r in found.collect()) == sorted(r.id for r in scan.collect()), q
        narrowed += few.count() < 100
    assert narrowed >= 12


def plain_pairs(days, intervals):
    return sorted((d, n) for d in days for n, a, b in intervals if d and a and b and a <= d <= b)


@pytest.mark.parametrize("levels", [16, 3])
def test_days_meet_the_intervals_that_hold_them(spark, levels):
    rng = random.Random(levels)
    day = lambda: date(1969, 11, 1) + timedelta(rng.randrange(120))
    intervals = [(n, rng.choice([day(), day(), None]), day()) for n in range(60)] + [(100, date(1, 1, 1), date(9999, 12, 31)), (101, date(1970, 1, 1), date(1970, 1, 1)), (102, date(1970, 1, 2), date(1970, 1, 1))]
    days = [day() for _ in range(40)] + [None, date(1970, 1, 1), date(1970, 1, 1)]
    left = spark.createDataFrame([(d,) for d in days], "day date")
    if levels == 3:
        intervals = [i for i in intervals if i[0] != 100]
    right = spark.createDataFrame(intervals, "n int, a date, b date")
    got = with_intervals(left, "day", right, "a", "b", levels)
    assert sorted((r.day, r.n) for r in got.collect()) == plain_pairs(days, intervals)
    # a year is a dozen blocks, no two of which meet
    blocks = spark.range(1).select(blocks_of(F.lit("2025-01-05").cast("date"), F.lit("2026-01-04").cast("date")).alias("b")).first().b
    held = sorted(d for b in blocks for d in range(b.place << b.level, (b.place + 1) << b.level))
    first = (date(2025, 1, 5) - date(1970, 1, 1)).days
    assert held == list(range(first, first + 365)) and len(blocks) <= 18



def test_report_and_totals_in_one_pass(t, spark, monkeypatch):
    """The totals are there before anything else runs, and equal those of their own query."""
    table, totals = events.category_report(t, "a")
    monkeypatch.setattr(type(t), "__getitem__", None)
    row = totals.collect()[0]
    monkeypatch.undo()
    assert row == events.category_totals(t, "a").first() and totals.schema.names == ["total_quota", "highest_price"]
    assert sorted(table.collect()) == sorted(events.category_directory(t, "a").collect())
    _, none = events.category_report(t, "no such category")
    assert tuple(none.first()) == (0, 0)
    register, summary = tickets.register_report(t, "administrator")
    assert tuple(summary.first()) == tuple(tickets.ticket_status_summary(t, "administrator").first())
    assert sorted(map(tuple, register.collect())) == sorted(map(tuple, tickets.ticket_register(t, "administrator").collect()))


def test_order_report_in_one_pass(t, spark):
    """Orders without customer are counted, not listed."""
    shop = t.replace(customer=t["customer"].orderBy("customer_id").offset(2))
    for role in ("admin", "customer"):
        ledger, totals = orders.order_report(shop, role)
        assert tuple(totals.first()) == tuple(orders.order_totals(shop, role).first())
        want = orders.order_ledger(shop)
        assert sorted(map(tuple, ledger.collect())) == sorted(map(tuple, want.collect())) and want.count() < shop["order"].count()
    _, none = orders.order_report(t.replace(order=t["order"].limit(0)), "admin")
    assert tuple(none.first()) == (0, 0, 0, 0)


def test_ranges_of_keys_are_disjoint_and_complete(spark):
    rng = random.Random(3)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(500)] + [None, str(uuid.UUID(int=0)), "f" * 8 + "-ffff-ffff-ffff-" + "f" * 12]
    ids += [str(uuid.UUID(int=(n << 128) // 7)) for n in range(1, 7)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    for parts in (1, 2, 7, 64):
        ranges = uuid_ranges("id", parts)
        assert len(ranges) == parts
        met = df.select("id", sum((F.coalesce(F.expr(r), F.lit(False)).cast("int") for r in ranges), F.lit(0)).alias("n"))
        assert met.filter("n <> 1").isEmpty()


def test_a_database_is_read_in_ranges(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(DataFrameReader, "jdbc", lambda self, url, table, predicates, properties: asked.append((url, table, len(predicates), properties)))
    Tables.load_jdbc(spark, "jdbc:none", "shop", parts={"order": 8}, driver="none.Driver")["order"]
    assert asked == [("jdbc:none", 'shop."ORDER"', 8, {"driver": "none.Driver"})]
