"""Tables in buckets: what a change set rewrites, and what a failed or repeated run leaves."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import changes as ch
from boxoffice.session import shared_dir
from boxoffice.sources.layout import Layout
from boxoffice.sources.tables import Tables, database_name
from tests.seed import CAT, ORDER, TICKET, uid


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/layout-{uuid.uuid4().hex}"


def files(folder, table):
    return {(os.path.basename(root), name) for root, _, names in os.walk(f"{folder}/{table}") for name in names if name.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_touched_buckets_are_rewritten(t, spark, folder):
    layout = Layout.create(t, folder, buckets=8)
    assert {n: rows(layout.tables()[n]) for n in t} == {n: rows(t[n]) for n in t}
    before = files(folder, "ticket_category")
    prices = spark.createDataFrame([(1, uid(CAT, 3), 777)], "seq long, category_id string, price int")
    change = ch.update_rows(layout.tables(), "ticket_category", prices)
    want = rows(ch.update_rows(t, "ticket_category", prices).tables["ticket_category"])
    assert layout.apply(change, "price of 3").rejects.isEmpty()
    after = files(folder, "ticket_category")
    changed = {bucket for bucket, _ in before - after}
    assert changed == {bucket for bucket, _ in after - before} and len(changed) == 1 and len({bucket for bucket, _ in before}) > 3
    again = Layout.open(spark, folder)
    assert rows(again.tables()["ticket_category"]) == want and again.buckets["ticket_category"] == 8


def test_a_change_reads_the_rows_of_its_keys(t, spark, folder):
    layout = Layout.create(t, folder, buckets=8)
    tables = layout.tables()
    asked = spark.createDataFrame([(uid(CAT, 3),)], "id string")
    found = tables.lookup("ticket_category", {"category_id": "id"}, asked)
    assert [r.category_id for r in found.collect()] == [uid(CAT, 3)]
    read = layout.rows("ticket_category", layout.touched("ticket_category", asked.toDF("category_id")))
    assert read.select(F.input_file_name()).distinct().count() == 1 < layout.rows("ticket_category").select(F.input_file_name()).distinct().count()
    assert rows(tables.lookup("ticket", {"torder_id": "id"}, spark.createDataFrame([(uid(ORDER, 1),)], "id string"))) == rows(t["ticket"].filter(F.col("torder_id") == uid(ORDER, 1)))


def test_deletes_empty_a_bucket(t, spark, folder):
    layout = Layout.create(t, folder, buckets=64)
    ids = t["ticket"].select("ticket_id").filter(F.col("ticket_id").isin([uid(TICKET, n) for n in range(1, 8)]))
    want = ch.delete_rows(t, "ticket", ids).apply(t)
    layout.apply(ch.delete_rows(layout.tables(), "ticket", ids), "refunds")
    for name in ("ticket", "has_relationship"):
        assert rows(layout.tables()[name]) == rows(want[name])


class Down(Exception):
    pass


def test_a_run_that_fails_between_two_tables_is_finished_by_the_next(t, spark, folder, monkeypatch):
    layout = Layout.create(t, folder, buckets=4)
    replace, done = Layout._replace, []

    def fails(self, name, *rest):
        if done:
            raise Down
        done.append(name)
        replace(self, name, *rest)

    monkeypatch.setattr(Layout, "_replace", fails)
    free = sorted({r.seat_id for r in t["seat"].collect()} - {r.seat_id for r in t["has_relationship"].collect()})[:2]
    requests = spark.createDataFrame([(1, uid(ORDER, 1), uid(CAT, 12), free[0]), (2, uid(ORDER, 2), uid(CAT, 7), free[1]), (3, "nobody", uid(CAT, 7), None)], "seq long, torder_id string, tcategory_id string, seat_id string")
    with pytest.raises(Down):
        layout.apply(ch.issue_tickets(layout.tables(), requests), "friday")
    assert len(done) == 1
    monkeypatch.setattr(Layout, "_replace", replace)

    def now():
        tables = Layout.open(spark, folder).tables()
        return {name: rows(tables[name]) for name in t}

    want = ch.issue_tickets(t, requests)
    expected = {**{n: rows(t[n]) for n in t}, **{n: rows(df) for n, df in want.tables.items()}}
    # the verdicts of the first run count, though one of its tables is there already
    applied = layout.apply(ch.issue_tickets(layout.tables(), requests), "friday")
    assert now() == expected
    assert [r.seq for r in applied.ids.orderBy("seq").collect()] == [1, 2] and [(r.seq, r.reason) for r in applied.rejects.collect()] == [(3, "unknown_order")]
    names = {n: files(folder, n) for n in ("ticket", "has_relationship")}
    repeated = layout.apply(ch.issue_tickets(layout.tables(), requests), "friday")
    assert now() == expected and {n: files(folder, n) for n in names} == names
    assert rows(repeated.ids) == rows(applied.ids)


def test_a_table_laid_out_by_another_column_is_refused(t, spark, folder):
    layout = Layout.create(t, folder, ["ticket_category", "event"], {"ticket_category": "tevent_id"})
    change = ch.update_rows(layout.tables(), "ticket_category", spark.createDataFrame([(uid(CAT, 1), 5)], "category_id string, quota int"))
    with pytest.raises(ValueError, match="laid out by tevent_id"):
        layout.apply(change, "x")


def test_empty_tables(t, spark, folder):
    empty = Tables(spark, {n: t[n].limit(0) for n in t})
    layout = Layout.create(empty, folder, ["venue"])
    assert layout.tables()["venue"].count() == 0
    venue = spark.createDataFrame([(1, "Hall", 10, "Street", "Jakarta", "Free Seating")], "seq long, venue_name string, capacity int, address string, city string, jenis_seating string")
    assert layout.apply(ch.append_rows(layout.tables(), "venue", venue), "first").ids.count() == 1
    assert layout.tables()["venue"].count() == 1


def test_load_and_write_folders(t, spark, folder):
    t.write(folder, ["venue", "seat"])
    loaded = Tables.load(spark, folder)
    assert rows(loaded["venue"]) == rows(t["venue"]) and rows(loaded["seat"]) == rows(t["seat"])
    with pytest.raises(Exception, match="already exists"):
        t.write(folder, ["venue"])
    assert database_name("shop", "order") == 'shop."ORDER"' and database_name("shop", "venue") == 'shop."venue"'
