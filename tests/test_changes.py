import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import DataFrame, DataFrameWriter
from pyspark.sql import functions as F

from boxoffice.functions.columns import stable_uuid
from boxoffice.operators import changes as ch
from boxoffice.operators import checks
import boxoffice.operators.conflicts as conflicts_module
import boxoffice.operators.settle as settle_module
from boxoffice.operators.settle import settle
from tests.seed import ARTIST, CAT, CUST, EVENT, ORDER, ORG, PASSWORD, PROMO, SEAT, TICKET, USER, VENUE, uid
from tests.test_checks import quota_shop, reasons


def refused(change, key):
    return {r[key]: r.reason for r in change.rejects.collect()}


def test_append_rows(t, spark):
    rows = [
        (1, "v1", "Hall", 10, "Street", "Jakarta", "Free Seating"), (2, None, "Hall 2", None, "Street", "Jakarta", "Free Seating"),
        (3, "v3", None, 10, "Street", "Jakarta", "Free Seating"), (4, "v4", "Hall", 0, "Street", "Jakarta", "Free Seating"),
        (5, "v5", "Hall", 10, "Street", "Jakarta", "Standing"), (6, "v1", "Hall", 10, "Street", "Jakarta", "Free Seating"),
        (7, "v4", "Hall", 10, "Street", "Jakarta", "Free Seating"), (8, uid(VENUE, 1), "Hall", 10, "Street", "Jakarta", "Free Seating"),
        (9, "v9", "H" * 101, 10, "Street", "Jakarta", "Free Seating"),
    ]
    df = spark.createDataFrame(rows, "seq long, venue_id string, venue_name string, capacity int, address string, city string, jenis_seating string")
    change = ch.append_rows(t, "venue", df, "b1")
    assert refused(change, "seq") == {3: "null", 4: "check", 5: "check", 6: "unique:venue_id", 8: "unique:venue_id", 9: "length"}
    new = change.tables["venue"]
    assert new.count() == 8 and new.schema.names == t["venue"].schema.names
    made = new.filter("venue_name = 'Hall 2'").first()
    assert made.capacity == 1 and len(made.venue_id) == 36
    assert made.venue_id == spark.range(1).select(stable_uuid(F.lit("venue"), F.lit("b1"), F.lit(2))).first()[0]


def test_append_rows_with_two_unique_keys_and_parents(t, spark):
    user = lambda n: uid(USER, n)
    rows = [
        (1, "c1", "A", user(1)), (2, "c1", "B", user(2)), (3, "c3", "C", user(2)), (4, "c4", "D", user(2)),
        (5, "c5", "E", user(7)), (6, "c6", "F", "nobody"), (7, "c6", "G", user(3)),
    ]
    df = spark.createDataFrame(rows, "seq long, customer_id string, full_name string, user_id string")
    change = ch.append_rows(t, "customer", df)
    assert refused(change, "seq") == {
        2: "unique:customer_id", 4: "unique:user_id", 5: "unique:user_id", 6: "reference:user_id",
    }


def test_update_rows(t, spark):
    rows = [(1, uid(CAT, 1), 60, "1"), (2, uid(CAT, 1), 70, "2.50"), (3, uid(CAT, 2), 0, "1"), (4, "nothing", 5, "1"), (5, uid(CAT, 3), None, "1")]
    df = spark.createDataFrame(rows, "seq long, category_id string, quota int, price string")
    change = ch.update_rows(t, "ticket_category", df)
    assert refused(change, "category_id") == {uid(CAT, 2): "check", "nothing": "unknown_key", uid(CAT, 3): "null"}
    new = {r.category_id: r for r in change.tables["ticket_category"].collect()}
    assert len(new) == 14 and (new[uid(CAT, 1)].quota, new[uid(CAT, 1)].price) == (70, Decimal("2.50"))
    assert new[uid(CAT, 2)].quota == 150
    moved = spark.createDataFrame([(uid(CAT, 1), "nowhere"), (uid(CAT, 2), uid(EVENT, 2))], "category_id string, tevent_id string")
    assert refused(ch.update_rows(t, "ticket_category", moved), "category_id") == {uid(CAT, 1): "reference:tevent_id"}


def test_update_rows_keeps_unique_values(t, spark):
    rows = [
        (1, uid(PROMO, 1), "HEMAT50K"), (2, uid(PROMO, 2), "HEMAT50K"), (3, uid(PROMO, 3), "NEW"), (4, uid(PROMO, 4), "NEW"),
        (5, uid(PROMO, 5), "X" * 51), (6, uid(PROMO, 6), "OTHER"),
    ]
    df = spark.createDataFrame(rows, "seq long, promotion_id string, promo_code string")
    change = ch.update_rows(t, "promotion", df)
    assert refused(change, "promotion_id") == {
        uid(PROMO, 1): "unique:promo_code", uid(PROMO, 4): "unique:promo_code", uid(PROMO, 5): "length",
    }
    assert checks.check_keys(change.apply(t), "promotion").isEmpty()
    unordered = ch.update_rows(t, "promotion", df.drop("seq"))
    assert set(refused(unordered, "promotion_id")) == {uid(PROMO, n) for n in (1, 4, 5)}


def ids(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_delete_rows(t, spark):
    change = ch.delete_rows(t, "venue", ids(spark, "venue_id", [uid(VENUE, 1), "none"]))
    assert refused(change, "venue_id") == {uid(VENUE, 1): "in_use", "none": "unknown_key"}
    assert change.tables["venue"].count() == 5 and change.tables["seat"].count() == 30

    bare = t.replace(event=t["event"].filter(F.lit(False)))
    change = ch.delete_rows(bare, "venue", ids(spark, "venue_id", [uid(VENUE, 1), uid(VENUE, 2), uid(VENUE, 4)]))
    assert refused(change, "venue_id") == {uid(VENUE, 1): "in_use"}, "a taken seat below the cascade blocks"
    assert change.tables["venue"].count() == 3 and change.tables["seat"].count() == 15

    change = ch.delete_rows(t, "ticket", ids(spark, "ticket_id", [uid(TICKET, 1), uid(TICKET, 3)]))
    assert change.tables["ticket"].count() == 18 and change.tables["has_relationship"].count() == 9

    users = ids(spark, "user_id", [uid(USER, 1), uid(USER, 3), uid(USER, 7), uid(USER, 16)])
    change = ch.delete_rows(t, "user_account", users)
    assert set(refused(change, "user_id")) == {uid(USER, 3), uid(USER, 7)}
    counts = {n: f.count() for n, f in change.tables.items()}
    assert counts == {"user_account": 14, "account_role": 14, "customer": 9, "organizer": 4}
    assert checks.check_foreign_keys(change.apply(t)).isEmpty()

    change = ch.delete_rows(t, "promotion", ids(spark, "promotion_id", [uid(PROMO, 5), uid(PROMO, 1)]))
    assert refused(change, "promotion_id") == {uid(PROMO, 1): "in_use"} and change.tables["promotion"].count() == 5


def test_delete_rows_by_their_whole_key(t, spark):
    pairs = spark.createDataFrame([(uid(EVENT, 1), uid(ARTIST, 1)), (uid(EVENT, 1), "who")], "event_id string, artist_id string")
    there = {(r.event_id, r.artist_id) for r in t["event_artist"].collect()}
    change = ch.delete_rows(t, "event_artist", pairs)
    gone = {(uid(EVENT, 1), uid(ARTIST, 1))} & there
    assert {(r.event_id, r.artist_id) for r in change.tables["event_artist"].collect()} == there - gone
    role, user = t["account_role"].first()
    change = ch.delete_rows(t, "account_role", spark.createDataFrame([(role, user)], "role_id string, user_id string"))
    assert change.tables["account_role"].count() == 15 and change.rejects.isEmpty()


def test_ambiguous_and_oversized_values_are_refused(t, spark):
    rows = [(uid(ORDER, 1), "LUNAS"), (uid(ORDER, 1), "PENDING"), (uid(ORDER, 2), "LUNAS"), (uid(ORDER, 2), "LUNAS"), (uid(ORDER, 3), "x" * 30)]
    change = ch.update_order_status(t, spark.createDataFrame(rows, "order_id string, payment_status string"))
    assert change.tables["order"].count() == 12
    assert refused(change, "order_id") == {uid(ORDER, 1): "ambiguous_key", uid(ORDER, 3): "length"}
    big = spark.createDataFrame([(1, uid(CAT, 1), "99999999999.00"), (2, uid(CAT, 2), "12.5")], "seq long, category_id string, price string")
    change = ch.update_rows(t, "ticket_category", big)
    assert refused(change, "category_id") == {uid(CAT, 1): "type"}
    new = spark.createDataFrame([(1, "n1", "A", "99999999999"), (2, "n2", "B", "5")], "seq long, category_id string, category_name string, price string")
    change = ch.append_rows(t, "ticket_category", new.withColumn("tevent_id", F.lit(uid(EVENT, 1))))
    assert refused(change, "seq") == {1: "type"} and change.tables["ticket_category"].count() == 15


def test_orders_need_a_customer_and_a_total_that_fits(t, spark):
    rows = [(1, uid(CUST, 1), "10.00", True, None), (2, "nobody", "10.00", True, None), (3, None, "10.00", True, None), (4, uid(CUST, 1), "-1.00", True, None),
            (5, uid(CUST, 1), "12345678901.00", True, None), (6, "nobody", None, False, "bad_promo")]
    df = spark.createDataFrame(rows, "cart_id long, customer_id string, total_price string, accepted boolean, reason string")
    change = ch.place_orders(t, df.withColumn("total_price", F.col("total_price").cast("decimal(20,2)")), "2026-06-01")
    assert refused(change, "cart_id") == {2: "reference:customer_id", 3: "null", 4: "check", 5: "type", 6: "bad_promo"}
    assert change.tables["order"].count() == 13


def test_registrations_keep_the_lengths_of_all_tables(t, spark):
    kind = "seq long, role_name string, username string, password string, full_name string, phone_number string, organizer_name string, contact_email string"
    rows = [(1, "customer", "newone", "p" * 8, "N" * 101, None, None, None), (2, "customer", "newtwo", "p" * 8, "N", "1" * 21, None, None),
            (3, "organizer", "newthree", "p" * 8, "N" * 300, "1" * 50, "Org", "m" * 101), (4, "customer", "u" * 101, "p" * 8, "N", None, None, None),
            (5, "customer", "newfive", "p" * 256, "N", None, None, None), (6, "organizer", "newsix", "p" * 8, "N" * 300, "1" * 50, "Org", None)]
    change = ch.register_users(t, spark.createDataFrame(rows, kind))
    assert refused(change, "seq") == {n: "length" for n in (1, 2, 3, 4, 5)}
    assert change.tables["user_account"].count() == 17 and change.tables["organizer"].count() == 5


def test_replace_event_artists(t, spark):
    rows = [
        (1, uid(EVENT, 1), [uid(ARTIST, 8), "", None, uid(ARTIST, 7)]), (2, uid(EVENT, 2), [uid(ARTIST, 1), uid(ARTIST, 1)]),
        (3, uid(EVENT, 3), ["who"]), (4, "none", [uid(ARTIST, 1)]), (5, uid(EVENT, 4), []),
    ]
    df = spark.createDataFrame(rows, "seq long, event_id string, artist_ids array<string>")
    change = ch.replace_event_artists(t, df)
    assert refused(change, "seq") == {2: "bad_artists", 3: "bad_artists", 4: "unknown_event"}
    links = {(r.event_id, r.artist_id, r.role) for r in change.tables["event_artist"].collect()}
    assert {x for x in links if x[0] == uid(EVENT, 1)} == {(uid(EVENT, 1), uid(ARTIST, n), None) for n in (7, 8)}
    assert len(links) == 10


def test_replace_event_categories(t, spark):
    clean = t.replace(ticket=t["ticket"].filter(~F.col("tcategory_id").isin(uid(CAT, 5), uid(CAT, 14))))
    rows = [
        (1, uid(EVENT, 2), ["A", "", "C", "D"], ["10", "20", "30.5"], ["1", "2", "3", "4"]),
        (2, uid(EVENT, 6), ["A"], ["cheap"], ["1"]), (3, uid(EVENT, 1), ["A"], ["1"], ["1"]), (4, "none", ["A"], ["1"], ["1"]),
    ]
    df = spark.createDataFrame(rows, "seq long, event_id string, names array<string>, prices array<string>, quotas array<string>")
    change = ch.replace_event_categories(clean, df)
    assert refused(change, "seq") == {2: "bad_categories", 3: "sold_categories", 4: "unknown_event"}
    new = change.tables["ticket_category"].filter(F.col("tevent_id") == uid(EVENT, 2)).orderBy("category_name").collect()
    assert [(r.category_name, r.price, r.quota) for r in new] == [("A", Decimal("10.00"), 1), ("C", Decimal("30.50"), 3)]


def test_update_tickets(t, spark):
    shop = t.replace(ticket=t["ticket"].withColumn("status", F.lit("VALID")))
    rows = [
        (1, uid(TICKET, 1), "terpakai", uid(SEAT, 3)), (2, uid(TICKET, 2), "void", uid(SEAT, 4)), (3, uid(TICKET, 4), None, "tanpa_kursi"),
        (4, uid(TICKET, 99), "void", ""), (5, uid(TICKET, 5), "void", "nowhere"), (6, uid(TICKET, 8), "void", uid(SEAT, 7)),
    ]
    df = spark.createDataFrame(rows, "seq long, ticket_id string, status string, seat_id string")
    change = ch.update_tickets(shop, df)
    assert refused(change, "seq") == {2: "seat_taken", 4: "unknown_ticket", 5: "unknown_seat"}
    state = {r.ticket_id: r.status for r in change.tables["ticket"].collect()}
    assert (state[uid(TICKET, 1)], state[uid(TICKET, 2)], state[uid(TICKET, 8)]) == ("TERPAKAI", "VALID", "VOID")
    links = {(r.ticket_id, r.seat_id) for r in change.tables["has_relationship"].collect()}
    assert (uid(TICKET, 1), uid(SEAT, 3)) in links and (uid(TICKET, 1), uid(SEAT, 1)) not in links
    assert not any(k == uid(TICKET, 4) for k, _ in links) and len(links) == 9
    assert set(ch.update_tickets(t, df).tables) == {"has_relationship"}


def test_ticket_changes_are_computed_once(t, spark):
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    rows = [(n, uid(TICKET, n), "void", uid(SEAT, n % 3 + 1)) for n in range(1, 6)]
    df = spark.createDataFrame(rows, "seq long, ticket_id string, status string, seat_id string").mapInArrow(seen, "seq long, ticket_id string, status string, seat_id string")
    change = ch.update_tickets(t, df)
    change.tables["has_relationship"].collect(), change.rejects.collect()
    assert counted.value == len(rows)


@pytest.mark.parametrize("seed, component_rows", [(7, 0), (8, 12), (9, 1000)])
def test_settle_replay(spark, seed, component_rows):
    rng = random.Random(seed)
    cand = [
        (n, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"uvwxyz"]), rng.choice("pq"), rng.choice([None, 2, 3, 9]), rng.random() < 0.9)
        for n in range(80)
    ]
    room = {"p": rng.choice([4, 30]), "q": None}
    cand = [(n, a, b, g, room[g], ok) for n, a, b, g, _, ok in cand]
    df = spark.createDataFrame(rng.sample(cand, len(cand)), "seq long, a string, b string, g string, room int, ok boolean")
    out = {r.seq: r for r in settle(df, F.col("ok"), {"one": ["a"], "two": ["b"]}, ("g", "room"), component_rows).collect()}
    held_a, held_b, count = set(), set(), {"p": 0, "q": 0}
    for n, a, b, g, places, ok in cand:
        verdict = (a in held_a, b in held_b, places is not None and count[g] >= places)
        assert (out[n]._taken_one, out[n]._taken_two, out[n]._full) == verdict, n
        gets_in = ok and not any(verdict)
        assert out[n]._in == gets_in, n
        if gets_in:
            held_a |= {a} - {None}
            held_b |= {b} - {None}
            count[g] += 1


def chain(spark, rows):
    return spark.createDataFrame([(n, n // 2, (n + 1) // 2) for n in range(rows)], "seq long, a long, b long")


def test_settle_long_chain(spark):
    out = {r.seq: r._in for r in settle(chain(spark, 500), F.lit(True), {"a": ["a"], "b": ["b"]}).collect()}
    assert out == {n: n % 2 == 0 for n in range(500)}


def test_long_paths_are_followed_by_doubling(spark, monkeypatch):
    """No component may be walked through, yet a chain of 5,000 rows ends in a few steps."""
    rounds = []
    marked = settle_module._marked
    monkeypatch.setattr(settle_module, "_marked", lambda *a: (rounds.append(1), marked(*a))[1])
    out = {r.seq: r._in for r in settle(chain(spark, 5000), F.lit(True), {"a": ["a"], "b": ["b"]}, component_rows=0).collect()}
    assert out == {n: n % 2 == 0 for n in range(5000)}
    assert len(rounds) <= 3


@pytest.mark.parametrize("seed, rows, block", [(21, 400, 100), (22, 150, 20), (23, 150, 1000)])
def test_large_components_go_in_blocks(spark, monkeypatch, seed, rows, block):
    """A chain whose groups fill up, with values that come again later: as many steps as there are blocks, no round per link."""
    rounds, rng = [], random.Random(seed)
    monkeypatch.setattr(settle_module, "BLOCK_ROWS", block, raising=False)
    marked = settle_module._marked

    def once(*a):
        rounds.append(1)
        assert len(rounds) == 1
        return marked(*a)

    monkeypatch.setattr(settle_module, "_marked", once)
    cand = [(n, n // 2, rng.choice([None, (n + 1) // 2, (n + 1) // 2 % 40]), n // 2 % 10) for n in range(rows)]
    room = {g: rng.choice([None, 1, 4, 7]) for g in range(10)}
    cand = [(*row, room[row[3]]) for row in cand]
    df = spark.createDataFrame(rng.sample(cand, rows), "seq long, a long, b long, g long, room int")
    out = {r.seq: r._in for r in settle(df, F.lit(True), {"one": ["a"], "two": ["b"]}, ("g", "room"), component_rows=2).collect()}
    held_a, held_b, count = set(), set(), {g: 0 for g in room}
    for n, a, b, g, places in cand:
        gets_in = a not in held_a and b not in held_b and (places is None or count[g] < places)
        assert out[n] == gets_in, n
        if gets_in:
            held_a.add(a)
            held_b |= {b} - {None}
            count[g] += 1


def test_many_long_chains(spark, monkeypatch):
    """Chains of 500 rows, dealt at random: no row passes the driver, and the steps do not depend on the chains' length."""
    steps = []
    for module, name in ((settle_module, "_marked"), (conflicts_module, "_towards_larger")):
        original = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, name=name, original=original: (steps.append(name), original(*a))[1])
    monkeypatch.setattr(DataFrame, "collect", None)
    links = spark.range(200_000).selectExpr("id AS seq", "id DIV 2 AS a", "(id + 1) DIV 2 + id DIV 500 AS b")
    out = settle(links, F.lit(True), {"a": ["a"], "b": ["b"]})
    wrong = out.filter("_in <> (seq % 500 % 2 = 0)")
    assert wrong.isEmpty() and out.filter("_in").count() == 100_000
    assert steps.count("_marked") == 1 and steps.count("_towards_larger") <= 12


def test_steps_do_not_grow_with_a_component(spark, monkeypatch):
    """No rounds to label the components: as few tables are written for a chain of 6,000 rows as for one of 60."""
    written = []
    parquet = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), parquet(self, path, *a, **k))[1])
    for rows, most in ((60, 100_000), (6000, 100_000), (6000, 0)):
        written.clear()
        out = settle(chain(spark, rows), F.lit(True), {"a": ["a"], "b": ["b"]}, component_rows=most)
        assert out.filter("_in").count() == rows // 2 and len(written) <= 8


@pytest.mark.parametrize("seed, block", [(31, 15), (32, 40)])
def test_blocks_pass_on_what_is_held(spark, monkeypatch, seed, block):
    """All verdicts, also of rows that are not eligible, with values and groups that come again in far blocks."""
    monkeypatch.setattr(settle_module, "BLOCK_ROWS", block)
    rng = random.Random(seed)
    room = {g: rng.choice([None, 0, 1, 5, 9]) for g in "pqrstuvw"}
    cand = []
    for n in range(240):
        g = rng.choice("pqrstuvw")
        cand.append((n * 3, rng.choice([None, *(f"a{i}" for i in range(60))]), rng.choice([None, *range(90)]), rng.choice("xy"), g, room[g], rng.random() < 0.8))
    df = spark.createDataFrame(rng.sample(cand, len(cand)), "seq long, a string, b int, c string, g string, room int, ok boolean")
    out = {r.seq: r for r in settle(df, F.col("ok"), {"one": ["a"], "two": ["b", "c"]}, ("g", "room"), component_rows=10).collect()}
    one, two, count = set(), set(), dict.fromkeys(room, 0)
    for n, a, b, c, g, places, ok in cand:
        verdict = (a in one, (b, c) in two, places is not None and count[g] >= places)
        assert (out[n]._taken_one, out[n]._taken_two, out[n]._full) == verdict, n
        gets_in = ok and not any(verdict)
        assert out[n]._in == gets_in, n
        if gets_in:
            one |= {a} - {None}
            two |= {(b, c)} if b is not None else set()
            count[g] += 1


def test_requests_are_computed_once(spark):
    shop, _, _ = quota_shop(spark, random.Random(5))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    kinds = "seq long, torder_id string, tcategory_id string, seat_id string"
    asked = spark.createDataFrame([(n, f"o{n % 10}", f"c{n % 7}", f"s{n % 14}") for n in range(90)], kinds)
    assert ch.judge_tickets(shop, asked.mapInArrow(counted, kinds)).count() == 90
    assert read.value == 90


def test_settle_hot_value(spark):
    hot = spark.range(100_000).select(F.col("id").alias("seq"), F.lit("seat").alias("a"), (F.col("id") % 50_000).alias("b"), F.lit("g").alias("g"), F.lit(60_000).alias("room"))
    out = settle(hot, F.lit(True), {"a": ["a"], "b": ["b"]}, ("g", "room"))
    assert [r.seq for r in out.filter("_in").collect()] == [0]
    out = settle(hot, F.lit(True), {"b": ["b"]}, ("g", "room"))
    assert out.filter("_in").count() == 50_000 and out.filter("_in AND seq >= 50000").count() == 0


@pytest.mark.parametrize("seed", [11, 12])
def test_issue_tickets_replay(spark, seed):
    rng = random.Random(seed)
    shop, quotas, sold = quota_shop(spark, rng)
    seats = [*[f"s{n}" for n in range(14)], *["tanpa_kursi", "", None] * 4]
    cand = [(n, f"o{rng.randrange(10)}", f"c{rng.randrange(7)}", rng.choice(seats)) for n in range(90)]
    pairs = {(s[3], s[2]) for s in sold}
    taken, count, expected = {"s0", "s1"}, {k: sum(s[2] == k for s in sold) for k in quotas}, {}
    for n, order, category, seat in cand:
        seat = seat if seat and seat != "tanpa_kursi" else None
        if (order, category) in pairs:
            expected[n] = "duplicate_ticket"
        elif seat in taken:
            expected[n] = "seat_taken"
        elif category in quotas and count[category] >= quotas[category]:
            expected[n] = "quota_full"
        elif category not in quotas:
            expected[n] = "unknown_category"
        elif order == "o9":
            expected[n] = "unknown_order"
        elif seat in ("s12", "s13"):
            expected[n] = "unknown_seat"
        else:
            expected[n] = None
            pairs.add((order, category))
            taken |= {seat} - {None}
            count[category] += 1
    df = spark.createDataFrame(rng.sample(cand, len(cand)), "seq long, torder_id string, tcategory_id string, seat_id string")
    assert reasons(ch.judge_tickets(shop, df)) == expected
    change = ch.issue_tickets(shop, df)
    good = [n for n, r in expected.items() if r is None]
    assert change.tables["ticket"].count() == len(sold) + len(good)
    seated = sum(1 for n, _, _, s in cand if n in good and s and s != "tanpa_kursi")
    assert change.tables["has_relationship"].count() == 2 + seated
    code = change.tables["ticket"].filter("ticket_code like 'TTK-%'").first().ticket_code
    assert len(code) == 12 and code == code.upper()
    assert refused(change, "seq") == {n: r for n, r in expected.items() if r}


def test_a_request_refused_by_the_quota_leaves_its_seat_free(t, spark):
    full = t.replace(ticket_category=t["ticket_category"].withColumn("quota", F.when(F.col("category_id") == uid(CAT, 7), 0).otherwise(F.col("quota"))))
    rows = [(1, uid(ORDER, 1), uid(CAT, 7), uid(SEAT, 3)), (2, uid(ORDER, 1), uid(CAT, 2), uid(SEAT, 3)), (3, uid(ORDER, 1), uid(CAT, 1), uid(SEAT, 10))]
    df = spark.createDataFrame(rows, "seq long, torder_id string, tcategory_id string, seat_id string")
    assert reasons(ch.judge_tickets(full, df)) == {1: "quota_full", 2: None, 3: "duplicate_ticket"}


def test_place_orders_and_status(t, spark):
    priced = spark.createDataFrame(
        [(1, uid(CUST, 1), Decimal("10.50"), True, None), (2, uid(CUST, 2), None, False, "bad_promo"), (3, uid(CUST, 2), Decimal("-1"), True, None)],
        "cart_id long, customer_id string, total_price decimal(14,2), accepted boolean, reason string",
    )
    change = ch.place_orders(t, priced, "2026-05-26 10:00:00")
    new = change.tables["order"].filter("total_amount = 10.50").first()
    assert (new.payment_status, new.order_date) == ("PENDING", datetime(2026, 5, 26, 10))
    assert change.tables["order"].count() == 13 and refused(change, "cart_id") == {2: "bad_promo", 3: "check"}
    paid = ch.update_order_status(t, spark.createDataFrame([(uid(ORDER, 3), "LUNAS")], "order_id string, payment_status string"))
    assert paid.tables["order"].filter("payment_status = 'LUNAS'").count() == 8


def test_normalise_promotions(spark):
    df = spark.createDataFrame([("abc1", "Persentase"), ("x", "Nominal"), ("Y", "PERCENTAGE")], "promo_code string, discount_type string")
    assert [tuple(r) for r in ch.normalise_promotions(df).collect()] == [("ABC1", "PERCENTAGE"), ("X", "NOMINAL"), ("Y", "PERCENTAGE")]


def test_register_users(t, spark):
    rows = [
        (1, "customer", "newone", PASSWORD, "New One", "+62", None, None), (2, "organizer", "neworg", PASSWORD, None, None, "New Org", "a@b.c"),
        (3, "administrator", "boss", PASSWORD, None, None, None, None), (4, "customer", "NewOne", PASSWORD, "Other", None, None, None),
        (5, "pilot", "pilot", PASSWORD, "P", None, None, None), (6, "customer", "nameless", PASSWORD, None, None, None, None),
        (7, "customer", "nameless", PASSWORD, "Has Name", None, None, None), (8, "customer", "a b", PASSWORD, "X", None, None, None),
    ]
    schema = "seq long, role_name string, username string, password string, full_name string, phone_number string, organizer_name string, contact_email string"
    change = ch.register_users(t, spark.createDataFrame(rows, schema))
    assert refused(change, "seq") == {4: "duplicate_username", 5: "unknown_role", 6: "missing_name", 8: "bad_characters"}
    counts = {n: f.count() for n, f in change.tables.items()}
    assert counts == {"user_account": 20, "account_role": 20, "customer": 12, "organizer": 5}
    shop = change.apply(t)
    assert checks.check_foreign_keys(shop).isEmpty() and checks.check_keys(shop, "customer").isEmpty()


def test_update_profiles(t, spark):
    rows = [(uid(USER, 7), "Budi S", "+1"), (uid(USER, 3), "Andi W", None), (uid(USER, 1), "Admin", None), (uid(USER, 8), None, "+1")]
    change = ch.update_profiles(t, spark.createDataFrame(rows, "user_id string, name string, phone_number string"))
    assert refused(change, "user_id") == {uid(USER, 1): "unknown_key", uid(USER, 8): "null"}
    budi = change.tables["customer"].filter(F.col("user_id") == uid(USER, 7)).first()
    assert (budi.full_name, budi.phone_number) == ("Budi S", "+1")
    assert change.tables["organizer"].filter("organizer_name = 'Andi W'").first().contact_email == "organizer1@example.com"


def test_save_events(t, spark):
    shop = t.replace(ticket=t["ticket"].filter(F.col("tcategory_id") != uid(CAT, 5)))
    org, admin = uid(USER, 3), uid(USER, 1)
    good = ("2026-12-01", "20:00", uid(VENUE, 1), [uid(ARTIST, 1)], ["A", "B"], ["10", "20"], ["5", "6"])
    forms = [
        (1, None, org, "organizer", None, " New Show ", *good),
        (2, uid(EVENT, 2), org, "organizer", None, "Changed", *good),
        (3, uid(EVENT, 1), org, "organizer", None, "Changed", *good),
        (4, uid(EVENT, 4), org, "organizer", None, "Changed", *good),
        (5, None, admin, "admin", None, "Default Organizer", *good),
        (6, None, admin, "admin", uid(ORG, 4), "Named Organizer", *good),
        (7, None, admin, "admin", "nobody", "X", *good),
        (8, None, admin, "admin", None, " ", *good),
        (9, None, admin, "admin", None, "X", "2026-12-32", *good[1:]),
        (10, None, uid(USER, 7), "customer", None, "X", *good),
        (11, "none", admin, "admin", None, "X", *good),
        (12, None, admin, "admin", None, "X", *good[:2], "nowhere", *good[3:]),
        (13, None, admin, "admin", None, "X", *good[:3], ["who"], *good[4:]),
        (14, None, admin, "admin", None, "X", *good[:6], ["five", "6"]),
        (15, None, uid(USER, 8), "organizer", None, "X", *good),
    ]
    schema = (
        "seq long, event_id string, user_id string, role string, organizer_id string, title string, date string, time string, "
        "venue_id string, artist_ids array<string>, names array<string>, prices array<string>, quotas array<string>"
    )
    change = ch.save_events(shop, spark.createDataFrame(forms, schema))
    assert refused(change, "seq") == {
        3: "sold_categories", 4: "not_owner", 7: "no_organizer", 8: "blank_title", 9: "bad_date", 10: "no_access",
        11: "unknown_event", 12: "unknown_venue", 13: "bad_artists", 14: "bad_categories", 15: "no_organizer",
    }
    rows = {r.event_title: r for r in change.tables["event"].collect()}
    assert len(rows) == 9 and "Festival Seni Budaya" not in rows
    assert rows["New Show"].organizer_id == uid(ORG, 1) and rows["New Show"].event_datetime == datetime(2026, 12, 1, 20)
    assert rows["Default Organizer"].organizer_id == uid(ORG, 1) and rows["Named Organizer"].organizer_id == uid(ORG, 4)
    assert change.tables["ticket_category"].filter(F.col("tevent_id") == rows["New Show"].event_id).count() == 2
    assert change.tables["event_artist"].filter(F.col("event_id") == uid(EVENT, 2)).count() == 1
    assert checks.check_foreign_keys(change.apply(shop)).isEmpty()
