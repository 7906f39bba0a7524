import random
import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import candidates as c
from boxoffice.operators import checks
from boxoffice.operators.spread import running_counts, spread_join
from boxoffice.schemas import TABLES
from boxoffice.sources.tables import Tables
from tests.seed import ARTIST, CAT, EVENT, ORDER, PROMO, SEAT, TICKET, USER, VENUE, uid


def reasons(df):
    return {r.seq: r.reason for r in df.collect()}


def small(spark, **rows):
    """Tables with the given rows; money, dates and unused columns may be left to the caller."""
    return Tables.from_rows(spark, {name: rows.get(name, []) for name in TABLES})


def test_declared_rules_hold_on_the_seed(t):
    for name, spec in TABLES.items():
        for check in (checks.check_not_null, checks.check_lengths, checks.check_rules):
            assert check(t[name], name).filter(~F.col("accepted")).isEmpty(), (check, name)
        assert checks.check_keys(t, name).isEmpty(), name
    assert checks.check_foreign_keys(t).isEmpty()


def test_declared_rules_find_broken_rows(t, spark):
    spec = t["promotion"].schema
    for field in spec.fields:
        field.nullable = True
    day = date(2026, 1, 1)
    rows = [
        ("a", "X", "NOMINAL", Decimal(1), day, day, 1),
        ("b", "Y", "HALF", Decimal(0), day, day, 0),
        ("c", None, None, None, None, day, 1),
        ("d", "Z" * 51, "NOMINAL", Decimal(1), day, day, 1),
    ]
    df = spark.createDataFrame(rows, spec)
    got = lambda f: {r.promotion_id: r.reason for r in f(df, "promotion").collect()}
    assert got(checks.check_rules) == {
        "a": None, "b": "check:discounttype_check,check:discountvalue_check,check:usagelimit_check", "c": None, "d": None,
    }
    assert got(checks.check_not_null)["c"] == "null:promo_code,null:discount_type,null:discount_value,null:start_date"
    assert got(checks.check_lengths) == {"a": None, "b": None, "c": None, "d": "length:promo_code"}


def test_keys_and_references(t, spark):
    more = spark.createDataFrame([(uid(SEAT, 1), uid(TICKET, 1)), (uid(SEAT, 88), uid(TICKET, 99))], t["has_relationship"].schema)
    shop = t.replace(has_relationship=t["has_relationship"].unionByName(more))
    key = checks.check_keys(shop, "has_relationship").collect()
    assert [(r.key, r.rows) for r in key] == [(f"{uid(SEAT, 1)}|{uid(TICKET, 1)}", 2)]
    lost = {(r.constraint, r.key, r.rows) for r in checks.check_foreign_keys(shop).collect()}
    assert lost == {
        ("reference:has_relationship(seat_id) to seat", uid(SEAT, 88), 1),
        ("reference:has_relationship(ticket_id) to ticket", uid(TICKET, 99), 1),
    }
    role = t["account_role"].unionByName(t["account_role"].limit(1).withColumn("role_id", F.lit("other")))
    assert checks.check_keys(t.replace(account_role=role), "account_role").first().constraint == "unique:account_role(user_id)"
    assert len([ref for spec in TABLES.values() for ref in spec.references]) == 17


def test_spread_join_keeps_rows_with_null_and_hot_keys(spark):
    left = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, F.lit(1)).when(F.col("id") < 950, F.lit(2)))
    facts = spark.createDataFrame([(1, "a"), (3, "c")], "k int, v string")
    for salts in (1, 5):
        got = spread_join(left, facts, ["k"], "id", salts=salts)
        assert got.count() == 1000 and got.filter("v = 'a'").count() == 900 and got.filter("v is null").count() == 100


def test_spread_join_lets_the_session_cut_a_hot_key(spark, capsys):
    """With facts that are an aggregate; a plain join would keep the hot key in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000)
        left = spark.range(0, 200_000, 1, 8).select("id", key.alias("k"), F.md5(F.col("id").cast("string")).alias("w"))
        facts = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 1000).alias("k")).agg(F.count("*").alias("n"))
        joined = spread_join(left, facts, ["k"], "id")
        assert len(joined.collect()) == 200_000
        joined.explain()
        assert "skew=true" in capsys.readouterr().out
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_running_counts(spark, bits):
    rng = random.Random(bits)
    rows = [(n * 3 - 50, rng.choice("aaab"), rng.random() < 0.6) for n in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, k string, ok boolean")
    got = {r.seq: (r.n, r.all) for r in running_counts(df, ["k"], {"n": F.col("ok"), "all": F.lit(True)}, bits=bits).collect()}
    for seq, k, _ in rows:
        before = [r for r in rows if r[1] == k and r[0] < seq]
        assert got[seq] == (sum(r[2] for r in before), len(before))


CAND_USER = "seq long, user_id string, username string, password string"


def test_usernames_edges(t, spark):
    rows = [
        (1, "n1", "abc\n", "12345678"), (2, "n2", " Abc ", "12345678"), (3, "n3", "a_b", "12345678"),
        (4, "n4", None, "12345678"), (5, "n5", "ABC", "12345678"), (6, "n6", "CUSTBUDI", "12345678"),
        (7, uid(USER, 7), "CustBudi", "12345678"), (8, "n8", "short", "1234567"), (9, "n9", "SHORT", "12345678"),
        (10, "n10", "short", "1"), (11, "n11", "fine", None), (12, "n12", "", "12345678"),
    ]
    out = c.check_usernames(t["user_account"], spark.createDataFrame(rows, CAND_USER))
    assert reasons(out) == {
        1: "bad_characters", 2: None, 3: "bad_characters", 4: "missing_username", 5: "duplicate_username",
        6: "duplicate_username", 7: None, 8: "short_password", 9: None, 10: "duplicate_username",
        11: "missing_password", 12: "bad_characters",
    }
    assert {r.seq: r.username for r in out.collect()}[2] == "Abc"


@pytest.mark.parametrize("seed", [1, 2])
def test_usernames_replay(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "A", "b", "B", "c", "c ", "d!", "e"])
    users = {f"u{n}": name for n, name in enumerate(["a", "c"])}
    cand = [(n, f"n{n}", word(), rng.choice(["12345678", "123"])) for n in range(60)]
    shop = small(spark, user_account=[(u, name, "x" * 8) for u, name in users.items()])
    table, expected = dict(users), {}
    for seq, user, name, password in cand:
        name = name.strip(" ")
        if not re.fullmatch("[a-zA-Z0-9]+", name):
            expected[seq] = "bad_characters"
        elif any(o.lower() == name.lower() and u != user for u, o in table.items()):
            expected[seq] = "duplicate_username"
        elif len(password) < 8:
            expected[seq] = "short_password"
        else:
            table[user], expected[seq] = name, None
    rng.shuffle(cand)
    assert reasons(c.check_usernames(shop["user_account"], spark.createDataFrame(cand, CAND_USER))) == expected


def test_venues(t, spark):
    rows = [
        (1, "x1", "ISTORA senayan", "jakarta"), (2, uid(VENUE, 4), "Istora Senayan", "Jakarta"),
        (3, "x3", "Istora Senayan", "Bandung"), (4, "x4", "istora senayan", "BANDUNG"), (5, "x5", None, "Bali"),
    ]
    df = spark.createDataFrame(rows, "seq long, venue_id string, venue_name string, city string")
    out = {r.seq: (r.accepted, r.existing_id) for r in c.check_venues(t["venue"], df).collect()}
    assert out == {1: (False, uid(VENUE, 4)), 2: (True, None), 3: (True, None), 4: (False, "x3"), 5: (True, None)}


def test_venue_deletes(t, spark):
    ids = spark.createDataFrame([(uid(VENUE, n),) for n in range(1, 7)], "venue_id string")
    got = {r.venue_id: (r.reason, r.events) for r in c.check_venue_deletes(t, ids, "2026-07-01").collect()}
    assert got[uid(VENUE, 1)] == ("has_events", 1) and got[uid(VENUE, 4)] == ("active_events", 2)
    assert got[uid(VENUE, 6)] == ("unknown_venue", 0)
    quiet = t.replace(event=t["event"].filter(F.col("venue_id") != uid(VENUE, 5)))
    assert c.check_venue_deletes(quiet, ids, "2026-07-01").filter("accepted").first().venue_id == uid(VENUE, 5)


def test_event_artists(t, spark):
    e, a = lambda n: uid(EVENT, n), lambda n: uid(ARTIST, n)
    rows = [(1, e(1), a(1)), (2, e(1), a(9)), (3, e(9), a(1)), (4, e(9), a(9)), (5, e(1), a(3)), (6, e(1), a(3)), (7, e(2), a(1)),
            (8, None, a(1)), (9, e(1), None), (10, None, a(1))]
    out = reasons(c.check_event_artists(t, spark.createDataFrame(rows, "seq long, event_id string, artist_id string")))
    assert out == {1: "duplicate_link", 2: "unknown_artist", 3: "unknown_event", 4: "unknown_artist", 5: None, 6: "duplicate_link", 7: None,
                   8: "unknown_event", 9: "unknown_artist", 10: "unknown_event"}


def test_seat_deletes(t, spark):
    ids = t["seat"].select("seat_id").unionByName(spark.createDataFrame([("zz",)], "seat_id string"))
    got = [r.reason for r in c.check_seat_deletes(t, ids).collect()]
    assert (got.count(None), got.count("seat_taken"), got.count("unknown_seat")) == (20, 10, 1)


def test_seats(t, spark):
    v = uid(VENUE, 1)
    rows = [
        (1, "s1", "wvip", "A", "1", v), (2, uid(SEAT, 1), "wvip", "A", "1", v), (3, "s3", "New", "A", "0", v),
        (4, "s4", "New", "A", "01", v), (5, "s5", "New", "A", "²", v), (6, "s6", "New", "A", "1", v),
        (7, "s7", "NEW", "A", "1", v), (8, "s8", "New", "A", None, v), (9, "s9", "New", "A", "1\n", v),
        (10, "s10", "New", "a", "1", v), (11, "s11", "New", "A", "99999999999999999999", v),
    ]
    df = spark.createDataFrame(rows, "seq long, seat_id string, section string, row_number string, seat_number string, venue_id string")
    assert reasons(c.check_seats(t, df)) == {
        1: "duplicate_seat", 2: None, 3: "bad_seat_number", 4: None, 5: "bad_seat_number", 6: None, 7: "duplicate_seat",
        8: "bad_seat_number", 9: "bad_seat_number", 10: None, 11: None,
    }


CAND_TICKET = "seq long, torder_id string, tcategory_id string"


def test_duplicate_tickets(t, spark):
    pairs = t["ticket"].groupBy("torder_id", "tcategory_id").count().filter("count = 2")
    assert pairs.count() == 6
    rows = [(1, uid(ORDER, 1), uid(CAT, 1)), (2, uid(ORDER, 1), uid(CAT, 2)), (3, uid(ORDER, 1), uid(CAT, 2)), (4, None, uid(CAT, 2)), (5, None, uid(CAT, 2))]
    out = c.check_duplicate_tickets(t, spark.createDataFrame(rows, CAND_TICKET))
    assert reasons(out) == {1: "duplicate_ticket", 2: None, 3: "duplicate_ticket", 4: None, 5: None}
    assert {r.seq: r.existing_code for r in out.collect()}[1] == "TTK-EVT001-WVIP-001"


def test_seat_free(t, spark):
    rows = [(1, uid(SEAT, 1)), (2, uid(SEAT, 3)), (3, uid(SEAT, 3)), (4, "tanpa_kursi"), (5, "tanpa_kursi"), (6, ""), (7, None)]
    out = reasons(c.check_seat_free(t, spark.createDataFrame(rows, "seq long, seat_id string")))
    assert out == {1: "seat_taken", 2: None, 3: "seat_taken", 4: None, 5: None, 6: None, 7: None}
    moves = [(1, uid(SEAT, 1), uid(TICKET, 1)), (2, uid(SEAT, 1), uid(TICKET, 2)), (3, uid(SEAT, 3), uid(TICKET, 3)), (4, uid(SEAT, 3), uid(TICKET, 6))]
    out = reasons(c.check_seat_free(t, spark.createDataFrame(moves, "seq long, seat_id string, ticket_id string")))
    assert out == {1: None, 2: "seat_taken", 3: None, 4: "seat_taken"}
    again = spark.createDataFrame([(uid(SEAT, 1), uid(TICKET, 3))], t["has_relationship"].schema)
    twice = t.replace(has_relationship=t["has_relationship"].unionByName(again))
    assert [tuple(r) for r in c.seats_with_many_tickets(twice).collect()] == [(uid(SEAT, 1), 2)]


def test_event_input(spark):
    rows = [
        (1, " Show ", "2026-06-15", "19:00"), (2, " \t", "2026-06-15", "19:00"), (3, "Show", "2026-02-30", "19:00"),
        (4, "Show", "2026-6-5", "9:05"), (5, "Show", "15-06-2026", "19:00"), (6, None, "2026-06-15", "19:00"), (7, "Show", None, "19:00"),
        (8, "Show", "2026-06-15", "19:00:30"),
    ]
    out = c.check_events(spark.createDataFrame(rows, "seq long, title string, date string, time string"))
    assert reasons(out) == {1: None, 2: "blank_title", 3: "bad_date", 4: None, 5: "bad_date", 6: "blank_title", 7: "bad_date", 8: "bad_date"}
    assert {r.seq: r.event_datetime for r in out.collect()}[4] == datetime(2026, 6, 5, 9, 5)


def test_event_owner(t, spark):
    rows = [
        (1, uid(EVENT, 1), uid(USER, 3), "organizer"), (2, uid(EVENT, 4), uid(USER, 3), "organizer"),
        (3, uid(EVENT, 4), uid(USER, 1), "admin"), (4, uid(EVENT, 4), uid(USER, 4), "customer"),
        (5, uid(EVENT, 9), uid(USER, 1), "admin"), (6, uid(EVENT, 1), uid(USER, 7), "organizer"),
    ]
    df = spark.createDataFrame(rows, "seq long, event_id string, user_id string, role string")
    assert reasons(c.check_event_owner(t, df)) == {1: None, 2: "not_owner", 3: None, 4: "no_access", 5: "unknown_event", 6: "not_owner"}


def quota_shop(spark, rng):
    quotas = {f"c{n}": rng.choice([1, 1, 3, 10, 40]) for n in range(6)}
    sold = [(f"k{n}", f"code{n}", f"c{rng.randrange(6)}", "o0") for n in range(10)]
    shop = small(
        spark,
        ticket_category=[(k, k, q, Decimal(1), "e") for k, q in quotas.items()],
        order=[(f"o{n}", datetime(2026, 1, 1), "LUNAS", Decimal(0), "x") for n in range(9)],
        ticket=sold,
        seat=[(f"s{n}", "A", str(n), "1", "v") for n in range(12)],
        has_relationship=[("s0", "k0"), ("s1", "k0")],
    )
    return shop, quotas, sold


@pytest.mark.parametrize("seed", [3, 4])
def test_quota_replay(spark, seed):
    rng = random.Random(seed)
    shop, quotas, sold = quota_shop(spark, rng)
    cand = [(n, f"o{rng.randrange(10)}", f"c{rng.choice([0, 1, 2, 3, 4, 5, 5, 5, 6])}") for n in range(120)]
    count, expected = {k: sum(s[2] == k for s in sold) for k in quotas}, {}
    for seq, order, category in cand:
        if category in quotas and count[category] >= quotas[category]:
            expected[seq] = "quota_full"
        elif category not in quotas:
            expected[seq] = "unknown_category"
        elif order == "o9":
            expected[seq] = "unknown_order"
        else:
            count[category] += 1
            expected[seq] = None
    rng.shuffle(cand)
    assert reasons(c.admit_tickets(shop, spark.createDataFrame(cand, CAND_TICKET))) == expected


def test_seed_redemptions(t, spark):
    bare = t.replace(order_promotion=t["order_promotion"].filter(F.lit(False)))
    uses = [(1, 1), (2, 5), (3, 8), (4, 11), (6, 9)]
    rows = [(n, uid(PROMO, p), uid(ORDER, o)) for n, (p, o) in enumerate(uses)]
    out = reasons(c.admit_redemptions(bare, spark.createDataFrame(rows, "seq long, promotion_id string, order_id string")))
    assert out == {0: None, 1: None, 2: None, 3: "outside_dates", 4: "outside_dates"}


@pytest.mark.parametrize("seed", [5, 6])
def test_redemption_replay(spark, seed):
    rng = random.Random(seed)
    promos = {f"p{n}": (rng.choice([1, 2, 5]), rng.randrange(1, 15), rng.randrange(10, 28)) for n in range(4)}
    dates = {f"o{n}": (None if n == 0 else rng.randrange(1, 28)) for n in range(8)}
    at = lambda d: datetime(2026, 1, d, 20)
    shop = small(
        spark,
        promotion=[(k, k, "NOMINAL", Decimal(1), at(s).date(), at(e).date(), q) for k, (q, s, e) in promos.items()],
        order=[(o, at(1), "LUNAS", Decimal(0), "x") for o in dates],
        event=[(f"e{o}{late}", at(min(d + late, 28)), "t", "v", "g") for o, d in dates.items() if d for late in (0, 5)],
        ticket_category=[(f"c{o}{late}", "n", 9, Decimal(1), f"e{o}{late}") for o, d in dates.items() if d for late in (0, 5)],
        ticket=[(f"k{o}{late}", f"k{o}{late}", f"c{o}{late}", o) for o, d in dates.items() if d for late in (5, 0)],
        order_promotion=[("u1", "p0", "o1"), ("u2", "p1", "o1")],
    )
    cand = [(n, f"p{rng.randrange(5)}", f"o{rng.randrange(9)}") for n in range(60)]
    used, expected = {"p0": 1, "p1": 1}, {}
    for seq, promo, order in cand:
        if promo not in promos:
            expected[seq] = "unknown_promotion"
            continue
        limit, start, end = promos[promo]
        day = dates.get(order)
        if used.get(promo, 0) >= limit:
            expected[seq] = "limit_reached"
        elif day is not None and not start <= day <= end:
            expected[seq] = "outside_dates"
        elif order not in dates:
            expected[seq] = "unknown_order"
        else:
            used[promo] = used.get(promo, 0) + 1
            expected[seq] = None
    rng.shuffle(cand)
    df = spark.createDataFrame(cand, "seq long, promotion_id string, order_id string")
    assert reasons(c.admit_redemptions(shop, df)) == expected


def test_references_are_counted_in_bounded_tasks(spark, t, monkeypatch):
    """One value in half of the rows, the others all different: as many tasks as the rows need, and the exact counts."""
    monkeypatch.setattr(checks, "TASK_ROWS", 500, raising=False)
    rows = spark.range(4000).selectExpr("cast(id AS string) AS ticket_id", "cast(id AS string) AS ticket_code", "CAST(NULL AS string) AS tcategory_id", "if(id % 2 = 0, 'hot', cast(id AS string)) AS torder_id")
    found = checks.check_foreign_keys(t.replace(ticket=rows), "ticket")
    assert found.rdd.getNumPartitions() >= 9
    lost = {r.key: r.rows for r in found.collect()}
    assert lost.pop("hot") == 2000 and len(lost) == 2000 and set(lost.values()) == {1}
