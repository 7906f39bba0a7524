"""Figures that follow change sets, and checks of what a change set breaks, against the whole tables."""

import random
import uuid
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.operators import changes as ch
from boxoffice.operators import checks, dashboards, tickets
from boxoffice.operators.deltas import Kept, rows_after
from boxoffice.session import shared_dir
from boxoffice.sources.layout import Layout
from tests.seed import CAT, EVENT, ORDER, TICKET, VENUE, uid


def bag(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_kept_figures_replay(spark, seed):
    """Rows come and go at random; only groups that lose an end are aggregated anew."""
    rng = random.Random(seed)
    schema = "i long, g string, x int"
    row = lambda i: (i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(6)]))
    old = [row(i) for i in range(rng.randrange(0, 25))]
    kept_rows = [r for r in old if rng.random() < 0.6]
    new = kept_rows + [row(i) for i in range(100, 100 + rng.randrange(0, 12))]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    figures = Kept(["g"], {"total": "coalesce(x, 0)"}, {"low": "x"}, {"high": "x"})
    gone = [r for r in old if r not in new] + old[:2]
    come = [r for r in new if r not in old] + old[:2]  # rows in both change nothing
    assert bag(figures.after(figures.of(frame(old)), frame(gone), frame(come), frame(new))) == bag(figures.of(frame(new)))
    whole = Kept([], {"total": "x"}, most={"high": "x"})
    assert bag(whole.after(whole.of(frame(old)), frame(gone), frame(come), frame(new))) == bag(whole.of(frame(new)))


def test_groups_that_lose_no_end_are_not_aggregated_anew(spark):
    figures = Kept(["g"], most={"high": "x"})
    old = spark.createDataFrame([("a", 1), ("a", 5), ("b", 7), ("b", 7), ("c", 3)], "g string, x int")
    gone = spark.createDataFrame([("a", 1), ("b", 7), ("c", 3)], "g string, x int")
    come = spark.createDataFrame([("c", 4)], "g string, x int")
    wrong = spark.createDataFrame([("a", 100), ("c", 100), ("b", 7)], "g string, x int")  # only b may be read here
    assert bag(figures.after(figures.of(old), gone, come, wrong)) == [("a", 5, 1), ("b", 7, 1), ("c", 4, 1)]


def test_sales_follow_orders_and_prices_at_once(t, spark):
    """One change set for both; the tickets are read once for the orders, and those of a new price once."""
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    orders = [(n, uid(ORDER, n), ["LUNAS", "PENDING", None][n % 3]) for n in range(1, 14)]
    prices = [(n, uid(CAT, n), n * 1000, uid(EVENT, 1 + n % 3)) for n in range(1, 15, 2)]
    status = ch.update_order_status(t, spark.createDataFrame(orders, "seq long, order_id string, payment_status string"))
    price = ch.update_rows(t, "ticket_category", spark.createDataFrame(prices, "seq long, category_id string, price int, tevent_id string"))
    stored = dashboards.paid_sales(t)
    watched = t.replace(ticket=t["ticket"].mapInArrow(seen, t["ticket"].schema))
    for change, most in ((status, 1), (price, 1), (ch.ChangeSet.of(t, {**status.rewrites, **price.rewrites}, status.rejects), 3)):
        counted.value = 0
        found = bag(dashboards.refreshed_paid_sales(watched, stored, change))
        assert 0 < counted.value <= most * t["ticket"].count()
        assert found == bag(dashboards.paid_sales(change.apply(t))) and found != bag(stored)


def random_changes(t, spark, rng):
    """A change set of a random kind, by its name and rows."""
    orders = [(n, uid(ORDER, rng.randrange(1, 14)), rng.choice(["LUNAS", "PENDING", "DIBATALKAN", None])) for n in range(6)]
    prices = [(n, uid(CAT, rng.randrange(1, 16)), rng.randrange(-1, 9) * 1000, uid(EVENT, rng.randrange(1, 7))) for n in range(5)]
    asked = [(n, uid(ORDER, rng.randrange(1, 13)), uid(CAT, rng.randrange(1, 15)), None) for n in range(8)]
    return [
        ch.update_rows(t, "order", spark.createDataFrame(orders, "seq long, order_id string, payment_status string")),
        ch.update_rows(t, "ticket_category", spark.createDataFrame(prices, "seq long, category_id string, price int, tevent_id string")),
        ch.issue_tickets(t, spark.createDataFrame(asked, "seq long, torder_id string, tcategory_id string, seat_id string")),
        ch.delete_rows(t, "ticket", t["ticket"].select("ticket_id").filter(F.col("ticket_id").isin([uid(TICKET, rng.randrange(1, 25)) for _ in range(4)]))),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_dashboards_follow_change_sets(t, spark, seed):
    stored, sold = dashboards.paid_sales(t), tickets.kept_sold(t)
    for change in random_changes(t, spark, random.Random(seed)):
        after = change.apply(t)
        sales = dashboards.refreshed_paid_sales(t, stored, change)
        assert bag(sales) == bag(dashboards.paid_sales(after))
        counts = tickets.refreshed_sold(t, sold, change)
        assert bag(tickets.category_utilisation(after, counts)) == bag(tickets.category_utilisation(after))
    assert bag(dashboards.organizer_dashboard(after, "2026-05-01", sales)) == bag(dashboards.organizer_dashboard(after, "2026-05-01"))


def full_check(t):
    names = [n for n in t if t[n].columns]
    return reduce(DataFrame.unionByName, [checks.check_keys(t, n) for n in names]).unionByName(checks.check_foreign_keys(t))


def test_broken_by_a_change(t, spark):
    """A venue with seats goes, a category comes twice and another for a show that is not there."""
    venue = ch.replace_rows(t, "venue", t["venue"].filter(F.col("venue_id") == uid(VENUE, 1)).select("venue_id"), t["venue"].limit(0))
    assert bag(checks.check_changes(t, venue)) == bag(full_check(venue.apply(t))) != []
    rows = t["ticket_category"].filter(F.col("category_id").isin(uid(CAT, 2), uid(CAT, 3)))
    rows = rows.withColumn("tevent_id", F.when(F.col("category_id") == uid(CAT, 3), F.lit("nowhere")).otherwise(F.col("tevent_id")))
    both = ch.replace_rows(t, "ticket_category", t["ticket_category"].filter(F.col("category_id") == uid(CAT, 5)).select("category_id"), rows)
    assert bag(checks.check_changes(t, both)) == bag(full_check(both.apply(t)))
    names = t["user_account"].limit(2).select(F.lit("new").alias("user_id"), "username", "password")
    twice = ch.replace_rows(t, "user_account", t["user_account"].limit(0).select("user_id"), names)
    assert bag(checks.check_changes(t, twice)) == bag(full_check(twice.apply(t))) != []


def test_a_legal_change_breaks_nothing(t, spark):
    for change in random_changes(t, spark, random.Random(7))[2:]:
        assert checks.check_changes(t, change).isEmpty()


def test_checks_read_children_by_touched_keys(t, spark, monkeypatch):
    """With tables laid out by the reference, a category that goes is looked up in one bucket of the tickets."""
    layout = Layout.create(t, f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}", by={"ticket": "tcategory_id"}, buckets=32)
    tables, read = layout.tables(), {}
    original = Layout.rows
    monkeypatch.setattr(Layout, "rows", lambda self, name, buckets=None: (read.setdefault(name, []).append(buckets), original(self, name, buckets))[1])
    gone = spark.createDataFrame([(uid(CAT, 2),)], "category_id string")
    change = ch.replace_rows(t, "ticket_category", gone, t["ticket_category"].limit(0))
    change.rewrites["ticket_category"].keys = gone
    found = checks.check_changes(tables, change)
    assert [(r.constraint, r.rows) for r in found.collect()] == [("reference:ticket(tcategory_id) to ticket_category", 4)]
    assert read["ticket"] and all(b is not None and len(b) == 1 for b in read["ticket"])
    assert bag(rows_after(tables, change, "ticket_category", {"category_id": "category_id"}, gone)) == []
