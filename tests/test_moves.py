"""Values taken and given up in a batch, against a loop over the rows."""

import random

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import changes as ch
from boxoffice.operators.moves import moved
from tests.seed import TICKET, uid


def plain(cand, existing):
    holds = {}
    for key, who in existing:
        holds.setdefault(key, set()).add(who)
    taken = {}
    for seq, who, key, ok in sorted(cand):
        me = who if who is not None else object()
        taken[seq] = key is not None and bool(holds.get(key, set()) - {me})
        if ok and not taken[seq]:
            for others in holds.values():
                others.discard(me)
            if key is not None:
                holds.setdefault(key, set()).add(me)
    return taken


@pytest.mark.parametrize("seed, component_rows", [(1, 1000), (2, 0), (3, 5), (4, 1000)])
def test_moves_replay(spark, seed, component_rows):
    rng = random.Random(seed)
    ids = [f"i{n}" for n in range(14)]
    existing = [(rng.choice("abcdefg"), i) for i in ids[:8]] + [("h", "outside")]
    cand = [(n, rng.choice([*ids, None]), rng.choice([*"abcdefghijk", None]), rng.random() < 0.85) for n in range(40 if component_rows < 100 else 200)]
    df = spark.createDataFrame(rng.sample(cand, len(cand)), "seq long, i string, k string, ok boolean")
    old = spark.createDataFrame(existing, "k string, i string")
    got = {r.seq: (r._taken, r.existing_id) for r in moved(df, old, ["k"], "i", F.col("ok"), component_rows).collect()}
    want = plain(cand, existing)
    assert {seq: taken or False for seq, (taken, _) in got.items()} == want
    assert all(holder is None for taken, holder in got.values() if not taken)


def test_hot_key_is_settled_in_few_rounds(spark, monkeypatch):
    """A seat that is given up once, and many requests for it before and after."""
    import boxoffice.operators.moves as module

    rounds = []
    original = module._round
    monkeypatch.setattr(module, "_round", lambda *a: (rounds.append(1), original(*a))[1])
    rows = spark.range(20_000).selectExpr("id AS seq", "if(id = 10000, 'owner', concat('t', id)) AS i", "if(id = 10000, 'other', 'seat') AS k")
    old = spark.createDataFrame([("seat", "owner")], "k string, i string")
    out = moved(rows, old, ["k"], "i", F.lit(True), component_rows=10)
    assert [r.seq for r in out.filter("NOT _taken").orderBy("seq").collect()] == [10_000, 10_001]
    assert len(rounds) <= 4


def test_swaps_and_double_moves_of_tickets(t, spark):
    """Seats 1 and 2 belong to tickets 1 and 2."""
    shop = t.replace(ticket=t["ticket"].withColumn("status", F.lit("VALID")))
    s = {r.ticket_id: r.seat_id for r in t["has_relationship"].collect()}
    one, two, three, six = (uid(TICKET, n) for n in (1, 2, 3, 6))
    free = sorted({r.seat_id for r in t["seat"].collect()} - set(s.values()))[0]
    kind = "seq long, ticket_id string, status string, seat_id string"

    def run(rows):
        change = ch.update_tickets(shop, spark.createDataFrame(rows, kind))
        links = {(r.ticket_id, r.seat_id) for r in change.tables["has_relationship"].collect()}
        state = {r.ticket_id: r.status for r in change.tables["ticket"].collect()}
        return links, state, {r.seq: r.reason for r in change.rejects.collect()}

    links, state, rejects = run([(1, one, "void", ""), (2, two, "terpakai", s[one])])
    assert rejects == {} and (two, s[one]) in links and not any(k == one for k, _ in links) and (two, s[two]) not in links
    assert (state[one], state[two]) == ("VOID", "TERPAKAI")

    # a ticket that moves twice frees the seat in between
    links, _, rejects = run([(1, one, None, free), (2, one, None, ""), (3, six, None, free)])
    assert rejects == {} and (six, free) in links and not any(k == one for k, _ in links)

    # refused as a whole: neither the status nor the seat changes
    links, state, rejects = run([(1, one, "x" * 30, free), (2, three, None, free), (3, two, None, s[one])])
    assert rejects == {1: "length", 3: "seat_taken"} and (one, s[one]) in links and (three, free) in links and state[one] == "VALID"


def test_names_given_up_in_the_batch(t, spark):
    from boxoffice.operators.candidates import check_usernames

    users = t["user_account"].orderBy("username").limit(2).collect()
    a, b = users
    rows = [(1, b.user_id, a.username, "p" * 8), (2, a.user_id, "freshname", "p" * 8), (3, b.user_id, a.username, "p" * 8), (4, "new", b.username, "p" * 8)]
    out = check_usernames(t["user_account"], spark.createDataFrame(rows, "seq long, user_id string, username string, password string"))
    assert {r.seq: r.reason for r in out.collect()} == {1: "duplicate_username", 2: None, 3: None, 4: None}

    first, second = t["promotion"].orderBy("promotion_id").limit(2).collect()
    codes = [(1, first.promotion_id, "FREED"), (2, second.promotion_id, first.promo_code)]
    change = ch.update_rows(t, "promotion", spark.createDataFrame(codes, "seq long, promotion_id string, promo_code string"))
    assert change.rejects.isEmpty()
    assert {r.promo_code for r in change.tables["promotion"].collect()} >= {"FREED", first.promo_code}


def test_a_chain_of_moves_in_one_pass(spark, monkeypatch):
    """Each ticket takes the seat that the one before it leaves: one ordered pass in a task, no round."""
    import boxoffice.operators.moves as module

    monkeypatch.setattr(module, "_round", None)
    n = 800
    rows = spark.range(n).selectExpr("id AS seq", "concat('t', id) AS i", "if(id = 0, 'free', concat('s', id - 1)) AS k")
    old = spark.range(n).selectExpr("concat('s', id) AS k", "concat('t', id) AS i")
    assert moved(rows, old, ["k"], "i", F.lit(True)).filter("_taken").isEmpty()
    backwards = rows.selectExpr(f"{n} - seq AS seq", "i", "k")
    out = moved(backwards, old, ["k"], "i", F.lit(True)).filter("NOT _taken").collect()
    assert [(r.seq, r.i) for r in out] == [(n, "t0")]


def test_nothing_is_written_where_nothing_is_given_up(spark, monkeypatch):
    import boxoffice.operators.moves as module

    monkeypatch.setattr(module, "staged", None)
    rows = spark.createDataFrame([(1, "i1", "a"), (2, "i2", "a"), (3, "i3", "b"), (4, None, "b"), (5, "i9", "c"), (5, "i9", "c")], "seq long, i string, k string")
    old = spark.createDataFrame([("a", "i0"), ("c", "i9")], "k string, i string")
    out = moved(rows, old, ["k"], "i", F.lit(True))
    assert sorted((r.seq, r._taken, r.existing_id) for r in out.collect()) == [(1, True, "i0"), (2, True, "i0"), (3, False, None), (4, True, "i3"), (5, False, None), (5, False, None)]
