import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from boxoffice.functions.columns import day_display, moment_display, weekday_display, whole_display
from boxoffice.operators import dashboards, events, orders, people, tickets
from boxoffice.operators.ranges import positions
from tests.seed import ARTIST, CAT, CUST, EVENT, ORDER, ORG, ROLE, SEAT, USER, VENUE, uid


def col(df, name):
    return [r[name] for r in df.collect()]


def no(value):
    """The number in a seed id."""
    return int(value[-12:])


def by_no(df, key, value):
    return {no(r[key]): r[value] for r in df.collect()}


def test_seed_has_177_rows(t):
    assert sum(t[name].count() for name in t) == 177


def test_artists(t, spark):
    assert events.artist_directory(t).count() == 8
    assert col(events.artist_directory(t, " pop "), "name") == ["Hindia", "Raisa", "Sheila On 7", "Tulus"]
    assert tuple(events.artist_totals(t).first()) == (8, 6)
    assert tuple(events.artist_totals(t, "pop").first()) == (4, 5)
    assert tuple(events.artist_totals(t, "nobody").first()) == (0, 0)
    assert events.artist_directory(t, "_").count() == 8, "an underscore is a wildcard here"
    extra = spark.createDataFrame([("x", "Blank", None)], t["artist"].schema)
    both = t.replace(artist=t["artist"].unionByName(extra))
    assert col(events.artist_directory(both, "blank"), "genre") == [None]
    assert events.artist_directory(both, "rock").count() == 2


def test_categories(t):
    assert tuple(events.category_totals(t).first()) == (6530, Decimal("2000000.00"))
    assert tuple(events.category_totals(t, "zzz").first()) == (0, Decimal("0.00"))
    rows = [(r.event_title, r.category_name) for r in events.category_directory(t, "vip").collect()]
    assert rows == [
        ("Konser Melodi Senja", "VIP"),
        ("Konser Melodi Senja", "WVIP"),
        ("Malam Akustik Bandung", "VIP"),
        ("Malam Akustik Bandung", "VVIP"),
    ]
    names = col(events.event_categories(t, uid(EVENT, 3)), "category_name")
    assert names == ["VVIP", "VIP", "Regular"]


def test_event_options(t):
    assert events.event_options(t, "administrator").count() == 6
    assert events.event_options(t, "organizer", uid(USER, 3)).count() == 3
    assert events.event_options(t, "organizer", uid(USER, 7)).count() == 0
    assert events.event_options(t, "customer", uid(USER, 7)).count() == 0


def test_primary_role(t, spark):
    roles = by_no(people.primary_role(t), "user_id", "role")
    assert [roles[n] for n in (1, 3, 7)] == ["administrator", "organizer", "customer"]
    links = spark.createDataFrame([(uid(ROLE, 3), uid(USER, 1)), (uid(ROLE, 2), uid(USER, 16))], t["account_role"].schema)
    more = t.replace(account_role=t["account_role"].filter(F.col("user_id") != uid(USER, 15)).unionByName(links))
    roles = by_no(people.primary_role(more), "user_id", "role")
    assert (roles[1], roles[16], roles[15]) == ("administrator", "organizer", "guest")


def test_profiles(t):
    rows = {no(r.user_id): r for r in people.user_profile(t).collect()}
    assert (rows[1].display_name, rows[1].page_role, rows[1].role_title) == ("adminnaeru", "admin", "Administrator")
    assert (rows[3].display_name, rows[3].phone_number) == ("Andi Wijaya", "-")
    assert (rows[7].display_name, rows[7].phone_number) == ("Budi Santoso", "+62812345678")


def test_earliest_events(t):
    assert [no(i) for i in col(events.earliest_events(t), "event_id")] == [1, 2, 3]


@pytest.mark.parametrize(
    "as_of, expected",
    [("2026-04-20", [3, 4, 3, 4, 2, 4, 0, 0, 0, 0]), ("2026-06-16", [1, 2, 1, 2, 1, 2, 0, 0, 0, 0])],
)
def test_active_tickets(t, as_of, expected):
    counts = by_no(people.active_ticket_count(t, as_of), "customer_id", "active_tickets")
    assert [counts[n] for n in range(1, 11)] == expected


def test_order_count_and_spend(t):
    counts = by_no(people.order_count(t), "customer_id", "order_count")
    assert [counts[n] for n in range(1, 11)] == [2] * 6 + [0] * 4
    texts = by_no(people.customer_spend(t), "customer_id", "spend_text")
    assert [texts[n] for n in range(1, 8)] == [
        "Rp 1.4M", "Rp 2.2M", "Rp 1.4M", "Rp 1.4M", "Rp 750K", "Rp 2.2M", "Rp 0K",
    ]


def test_next_tickets(t):
    rows = tickets.next_tickets(t, "2026-04-20").collect()
    first = sorted((no(r.customer_id), r.place, r.event_title, r.category_name) for r in rows)
    assert first[:4] == [
        (1, 1, "Konser Melodi Senja", "WVIP"),
        (1, 2, "Konser Melodi Senja", "WVIP"),
        (2, 1, "Konser Melodi Senja", "VIP"),
        (2, 2, "Konser Melodi Senja", "VIP"),
    ]
    assert len(rows) == 12


def test_organizers(t):
    assert by_no(people.organizer_event_count(t), "organizer_id", "event_count") == {1: 3, 2: 1, 3: 1, 4: 1}
    board = {no(r.organizer_id): r for r in dashboards.organizer_dashboard(t, "2026-07-01").collect()}
    assert [board[n].tickets_sold for n in range(1, 5)] == [11, 1, 0, 1]
    assert [int(board[n].revenue) for n in range(1, 5)] == [8500000, 500000, 0, 1200000]
    assert [board[n].partner_venues for n in range(1, 5)] == [3, 1, 1, 1]
    assert [board[n].active_events for n in range(1, 5)] == [2, 1, 1, 1]


def test_admin_dashboard(t):
    row = dashboards.admin_dashboard(t, "2026-06-20").first()
    assert (row.user_count, row.events_this_month, int(row.gross_volume)) == (16, 1, 6400000)
    assert (row.running_promos, row.promo_uses) == (4, 3)
    assert (row.venues, row.reserved_venues, row.largest_capacity) == (5, 2, 10000)


def test_ticket_register(t):
    assert tickets.ticket_register(t, "administrator").count() == 20
    rows = tickets.ticket_register(t, "administrator").collect()
    assert rows[0].event_title == "We The Fest Opening" and rows[-1].event_title == "Konser Melodi Senja"
    assert tickets.ticket_register(t, "organizer", uid(USER, 3)).count() == 20
    own = tickets.ticket_register(t, "customer", uid(USER, 7)).collect()
    assert {r.customer_name for r in own} == {"Budi Santoso"} and len(own) == 3
    assert tuple(tickets.ticket_status_summary(t, "administrator").first()) == (20, 20, 0)
    assert tuple(tickets.ticket_status_summary(t, "customer", uid(USER, 7)).first()) == (3, 3, 0)


def test_ticket_status_words(t):
    word = F.when(F.col("torder_id") == uid(ORDER, 8), " terpakai\t").when(F.col("torder_id") == uid(ORDER, 3), "Void")
    marked = t.replace(ticket=t["ticket"].withColumn("status", F.when(F.col("torder_id") == uid(ORDER, 1), "odd").otherwise(word)))
    assert tuple(tickets.ticket_status_summary(marked, "administrator").first()) == (20, 15, 3)


def test_paid_order_event(t):
    got = {no(r.order_id): no(r.event_id) for r in orders.paid_order_event(t).collect()}
    assert got == {1: 1, 2: 2, 5: 1, 6: 4, 8: 1, 9: 1, 11: 1}
    assert orders.paid_order_event(t).first().display == "b0000000 — Budi Santoso — Konser Melodi Senja"


def test_category_utilisation(t):
    rows = {no(r.category_id): r for r in tickets.category_utilisation(t).collect()}
    assert [rows[n].used for n in range(1, 15)] == [2, 4, 3, 2, 2, 1, 0, 2, 1, 0, 1, 1, 0, 1]
    assert not any(r.is_full for r in rows.values())
    assert rows[1].display == "WVIP — Rp 1,500,000 — (2/50)"
    assert rows[1].has_seat and not rows[5].has_seat


def test_remaining_quota(t):
    left = by_no(tickets.remaining_quota(t), "category_id", "remaining")
    assert [left[n] for n in range(1, 15)] == [48, 146, 297, 498, 498, 29, 100, 398, 999, 1500, 199, 499, 800, 499]
    assert by_no(tickets.remaining_quota(t, uid(EVENT, 2)), "category_id", "remaining") == {5: 498}
    with pytest.raises(ValueError):
        tickets.remaining_quota(t, "nowhere")


def test_seats(t, spark):
    assert tickets.free_seats(t).count() == 20
    assert tickets.free_seats(t, uid(VENUE, 1)).first().display == "Category 1 — Baris C, No. 4"
    assert tuple(tickets.seat_totals(t).first()) == (30, 10, 20)
    again = spark.createDataFrame([(uid(SEAT, 1), uid("c", 3))], t["has_relationship"].schema)
    twice = t.replace(has_relationship=t["has_relationship"].unionByName(again))
    states = [r.status for r in tickets.seat_inventory(twice).collect()]
    assert (states.count("TERISI"), states.count("TERSEDIA")) == (11, 20)
    assert tuple(tickets.seat_totals(twice).first()) == (30, 11, 19)
    assert tickets.free_seats(twice).count() == 20


def test_seat_with_very_many_tickets(t, spark):
    """The seat is one row in both joins and in the sort."""
    links = spark.range(150_000).selectExpr(f"'{uid(SEAT, 1)}' AS seat_id", "cast(id AS string) AS ticket_id")
    listed = tickets.seat_inventory(t.replace(has_relationship=links))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and plan.index("Generate") < plan.index("Sort")
    assert listed.filter("status = 'TERISI'").groupBy("seat_id").count().collect() == [(uid(SEAT, 1), 150_000)]
    assert listed.filter("status = 'TERSEDIA'").count() == 29


def test_venues(t):
    assert col(events.venue_cities(t), "city") == ["Bali", "Bandung", "Jakarta"]
    assert tuple(events.venue_totals(t).first()) == (29000, 2)
    assert tuple(events.venue_totals(t, city="Jakarta").first()) == (22000, 2)
    assert tuple(events.venue_totals(t, search="%").first()) == (0, 0), "a percent sign is literal here"
    assert col(events.venue_directory(t, search="jl."), "venue_name") == ["Bandung Hall Center", "Jakarta Convention Center"]
    assert events.venue_directory(t, seating="Reserved Seating", city="Jakarta").count() == 2


def test_event_catalog(t):
    assert [no(i) for i in col(events.event_catalog(t, "fest"), "event_id")] == [2, 6]
    assert [no(i) for i in col(events.event_catalog(t, artist_id=uid(ARTIST, 2)), "event_id")] == [1, 6]
    assert [no(i) for i in col(events.event_catalog(t, venue_id=uid(VENUE, 4), artist_id=uid(ARTIST, 2)), "event_id")] == [6]


def test_event_cards(t):
    rows = events.event_cards(t).collect()
    assert [r.price for r in rows] == ["250.000", "150.000", "350.000", "350.000", "250.000", "1.200.000"]
    assert [r.page for r in rows] == [0] * 6
    assert rows[0].artists == ["Fourtwnty", "Hindia"]
    assert rows[0].categories == ["WVIP", "VIP", "Category 1", "Category 2"]
    assert (rows[0].date, rows[0].time, rows[0].venue) == ("2026-06-15", "19:00", "Jakarta Convention Center")
    assert rows[1].ticket_categories_json == '[{"name":"General Admission","price":150000.0,"quota":500}]'
    assert events.organizer_events(t, uid(USER, 3)).count() == 3


def test_event_card_without_categories(t, spark):
    bare = t.replace(ticket_category=t["ticket_category"].filter(F.lit(False)), event_artist=t["event_artist"].filter(F.lit(False)))
    row = events.all_events(bare).first()
    assert (row.price, row.categories, row.artists, row.ticket_categories_json) == ("0", [], [], "[]")


def test_long_event_cards_go_on_over_pages(t, spark):
    started = spark.sparkContext.statusTracker()
    before = len(started.getJobIdsForGroup(None))
    more = spark.range(2500).selectExpr(
        "concat('cat', id) AS category_id", "concat('Row \"', id, '\"') AS category_name", "cast(1 AS int) AS quota",
        "cast(12000000 + id / 4 AS decimal(12,2)) AS price", f"'{uid(EVENT, 1)}' AS tevent_id",
    )
    cards = events.event_cards(t.replace(ticket_category=t["ticket_category"].unionByName(more)))
    assert len(started.getJobIdsForGroup(None)) == before, "building the frame runs nothing"
    rows = cards.filter(F.col("event_id") == uid(EVENT, 1)).collect()
    assert sorted(r.page for r in rows) == [0, 1, 2] and {r.price for r in rows} == {"250.000"}
    lists = [json.loads(r.ticket_categories_json) for r in rows]
    assert all(x == sorted(x, key=lambda c: -c["price"]) for x in lists) and [[c["name"] for c in x] for x in lists] == [r.categories for r in rows]
    assert len({c["name"] for x in lists for c in x}) == 2504 and sorted(a for r in rows for a in r.artists) == ["Fourtwnty", "Hindia"]
    assert any('"price":12000000.0,' in r.ticket_categories_json for r in rows)
    assert any('"price":12000000.25,' in r.ticket_categories_json for r in rows)
    assert events.event_cards(t, page_rows=2).count() > 6


def test_pages_of_event_cards_in_sequence_are_the_ordered_list(t, spark):
    more = spark.range(2500).selectExpr(
        "concat('cat', id) AS category_id", "concat('Row ', id) AS category_name", "cast(1 AS int) AS quota",
        "cast(100 + (id * 7919) % 1250 AS decimal(12,2)) AS price", f"'{uid(EVENT, 1)}' AS tevent_id",
    )
    categories = t["ticket_category"].unionByName(more)
    cards = events.event_cards(t.replace(ticket_category=categories)).filter(F.col("event_id") == uid(EVENT, 1))
    pages = [r.categories for r in cards.orderBy("page").collect()]
    lines = categories.filter(F.col("tevent_id") == uid(EVENT, 1)).collect()
    assert [len(p) for p in pages] == [1000, 1000, len(lines) - 2000]
    assert [c for p in pages for c in p] == [c.category_name for c in sorted(lines, key=lambda c: (-c.price, c.category_name))]


def test_displays(spark):
    rows = [("2026-06-05 09:05:30", "10.50"), ("2026-12-31 23:59:59", "11.49"), ("2024-02-29 00:00:00", "-2.50"), (None, None)]
    df = spark.createDataFrame(rows, "at string, price string").select(F.col("at").cast("timestamp_ntz"), F.col("price").cast("decimal(12,2)"))
    got = df.select(moment_display(F.col("at")), weekday_display(F.col("at")), day_display(F.col("at")), whole_display(F.col("price"))).collect()
    assert [tuple(r) for r in got[:3]] == [
        ("05 Jun, 2026 — 09:05", "Fri, 05 Jun 2026", "05 Jun 2026", "11"),
        ("31 Dec, 2026 — 23:59", "Thu, 31 Dec 2026", "31 Dec 2026", "11"),
        ("29 Feb, 2024 — 00:00", "Thu, 29 Feb 2024", "29 Feb 2024", "-3"),
    ]


def test_positions_match_a_window(spark):
    df = spark.range(0, 3000).select(
        "id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 13).alias("v")
    )
    got = positions(df, ["k"], [F.desc("v"), F.asc("id")], ranges=9).collect()
    rows = sorted(df.collect(), key=lambda r: (r.k, -r.v, r.id))
    place, expected = {}, {}
    for r in rows:
        place[r.k] = expected[r.id] = place.get(r.k, 0) + 1
    assert {r.id: r.position for r in got} == expected


def test_pick_lists(t):
    assert [no(i) for i in col(events.pick_list(t, "venues"), "venue_id")] == [5, 3, 4, 1, 2]
    assert col(events.pick_list(t, "artists"), "name")[0] == "Dewa 19"
    assert col(events.pick_list(t, "organizers"), "organizer_name")[0] == "Andi Wijaya"


def test_checkout_event(t):
    assert no(events.checkout_event(t, as_of="2026-06-16").first().event_id) == 2
    assert no(events.checkout_event(t, uid(EVENT, 4)).first().event_id) == 4
    assert events.checkout_event(t, as_of="2027-01-01").count() == 0


def test_checkout_seats(t):
    rows = tickets.checkout_seats(t).collect()
    labels = lambda n: [r.label for r in rows if r.event_id == uid(EVENT, n)]
    assert labels(1) == [
        "Category 1 - Baris C, No. 4", "Category 2 - Baris D, No. 3", "Category 2 - Baris D, No. 4",
        "Category 2 - Baris D, No. 5", "WVIP - Baris A, No. 3",
    ]
    numbers = ["1", "10", *map(str, range(2, 10))]
    assert labels(4) == [f"Tribune - Baris BB, No. {n}" for n in numbers] + [f"VVIP - Baris AA, No. {n}" for n in range(1, 6)]
    assert labels(2) == ["Tanpa Kursi"]
    assert [r.place for r in tickets.checkout_seats(t, 3).collect() if r.event_id == uid(EVENT, 6)] == [1, 2, 3]


def test_promotions(t):
    assert orders.unexpired_promo_count(t, "2026-05-26").first()[0] == 5
    codes = col(orders.running_promotions(t, "2026-05-26"), "promo_code")
    assert codes == ["PAYDAY100K", "NEWUSER30", "PROMO20", "HEMAT50K"]
    usage = {r.promo_code: r.current_usage for r in orders.promotion_usage(t).collect()}
    assert usage == {"PROMO20": 1, "HEMAT50K": 1, "NEWUSER30": 1, "PAYDAY100K": 1, "FLASH10": 1, "FESTIVALSERU": 0}
    assert tuple(orders.promotion_totals(t).first()) == (6, 5, 4)
    assert col(orders.promo_search(t, "flash"), "promo_code") == ["FLASH10"]


def test_orders(t):
    row = orders.order_totals(t, "admin").first()
    assert tuple(row) == (12, 7, 3, Decimal("6400000.00"))
    assert orders.order_totals(t, "customer").first().total_revenue == 0
    ledger = orders.order_ledger(t).collect()
    assert no(ledger[0].order_id) == 12 and ledger[0].customer_username == "custmaya"
    assert orders.order_search(t, "budi", "LUNAS").count() == 2
    assert orders.order_search(t, "0007").count() == 1
    shown = orders.ledger_display(orders.order_ledger(t)).first()
    assert (shown.short_id, shown.initial, shown.ordered_at) == ("b0000000-000…", "C", "2026-04-21 07:15")


CART = "cart_id long, event_id string, category_name string, quantity int, promo_code string, customer_id string"


def test_price_carts(t, spark):
    one, two = uid(EVENT, 1), uid(EVENT, 2)
    carts = [
        (1, one, "WVIP", 2, "PROMO20"), (2, two, "General Admission", 1, "HEMAT50K"),
        (3, two, "General Admission", 1, "PAYDAY100K"), (4, two, "General Admission", 1, "FLASH10"),
        (5, two, "General Admission", 0, None), (6, two, "General Admission", 11, None), (7, two, "WVIP", 1, None),
        (8, two, "General Admission", 10, ""), (9, two, "WVIP", 0, "FLASH10"), (10, two, "General Admission", None, None),
    ]
    df = spark.createDataFrame([(*c, uid(CUST, 1)) for c in carts], CART)
    priced = {r.cart_id: r for r in orders.price_carts(t, df, "2026-05-26").collect()}
    assert [int(priced[n].total_price) for n in (1, 2, 3, 8)] == [2400000, 100000, 50000, 1500000]
    assert [priced[n].reason for n in (4, 5, 6, 7, 9, 10)] == [
        "bad_promo", "bad_quantity", "bad_quantity", "unknown_category", "unknown_category", "bad_quantity",
    ]
    placed = orders.placed_orders(orders.price_carts(t, df, "2026-05-26"), "2026-05-26", "b1")
    assert placed.count() == 4 and len(set(col(placed, "order_id"))) == 4
    assert placed.first().order_date == datetime(2026, 5, 26)


def test_percentage_has_no_floor_and_names_take_the_lowest_price(t, spark):
    promo = spark.createDataFrame(
        [("p", "ALL", "PERCENTAGE", Decimal(120), *[datetime(2026, 1, 1).date(), datetime(2026, 12, 31).date()], 1),
         ("q", "CUT", "NOMINAL", Decimal(9999999), *[datetime(2026, 1, 1).date(), datetime(2026, 12, 31).date()], 1)],
        t["promotion"].schema,
    )
    twin = spark.createDataFrame([(uid(CAT, 99), "WVIP", 5, Decimal(1000), uid(EVENT, 1))], t["ticket_category"].schema)
    shop = t.replace(promotion=promo, ticket_category=t["ticket_category"].unionByName(twin))
    df = spark.createDataFrame([(n, uid(EVENT, 1), "WVIP", 1, c, "x") for n, c in ((1, "ALL"), (2, "CUT"), (3, None))], CART)
    priced = {r.cart_id: r.total_price for r in orders.price_carts(shop, df, "2026-05-26").collect()}
    assert priced == {1: Decimal("-200.00"), 2: Decimal("0.00"), 3: Decimal("1000.00")}
