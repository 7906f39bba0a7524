"""Candidate rows judged one after the other, as sets.

A candidate frame carries ``seq``, a unique long in order of arrival. Each check returns the candidates
with ``accepted`` and ``reason``; a rejected row holds no name, pair, seat, quota or promotion use.
Names, places and seats that an accepted row gives up are free for the rows after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.columns import NO_SEAT, blank, event_moment, moment, strip, valid_seat_number
from boxoffice.operators.checks import judged
from boxoffice.operators.moves import moved
from boxoffice.operators.spread import only_keys_of, running_counts, spread_join
from boxoffice.operators.tickets import sold_per_category, taken_seats
from boxoffice.sources.tables import Tables

PASSWORD_LENGTH = 8


def _all_set(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _yes(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def check_usernames(users: DataFrame, cand: DataFrame) -> DataFrame:
    """Letters and digits only, unique but for case, password column of eight characters at least."""
    named = cand.withColumn("username", F.trim("username")).withColumn("_name", F.lower("username"))
    well_formed = F.col("username").rlike(r"^[a-zA-Z0-9]+\z")
    long_enough = F.length("password") >= PASSWORD_LENGTH
    existing = users.select(F.lower("username").alias("_name"), "user_id")
    taken = moved(named, existing, ["_name"], "user_id", _yes(well_formed & long_enough))
    return judged(
        taken,
        [
            (~well_formed, "bad_characters"),
            (F.col("_taken"), "duplicate_username"),
            (~long_enough, "short_password"),
            (F.col("username").isNull(), "missing_username"),
            (F.col("password").isNull(), "missing_password"),
        ],
    ).select(*cand.columns, "accepted", "reason")


def check_venues(venues: DataFrame, cand: DataFrame) -> DataFrame:
    """Name and city unique but for case, the row itself aside; reports the id that is in the way."""
    keys = {"_name": F.lower("venue_name"), "_city": F.lower("city")}
    existing = venues.select(*[c.alias(k) for k, c in keys.items()], "venue_id")
    taken = moved(cand.withColumns(keys), existing, list(keys), "venue_id", F.lit(True))
    return judged(taken, [(F.col("_taken"), "duplicate_venue")]).select(
        *cand.columns, "existing_id", "accepted", "reason"
    )


def check_seats(t: Tables, cand: DataFrame) -> DataFrame:
    """Whole seat number from one up; place unique in its venue, the row itself aside."""
    keys = {
        "_venue": F.col("venue_id"),
        "_section": F.lower("section"),
        "_row": F.col("row_number"),
        "_number": F.col("seat_number"),
    }
    existing = t["seat"].select(*[c.alias(k) for k, c in keys.items()], "seat_id")
    fine = valid_seat_number(F.col("seat_number"))
    taken = moved(cand.withColumns(keys), existing, list(keys), "seat_id", fine)
    return judged(taken, [(~fine, "bad_seat_number"), (F.col("_taken"), "duplicate_seat")]).select(
        *cand.columns, "existing_id", "accepted", "reason"
    )


def check_venue_deletes(t: Tables, ids: DataFrame, as_of) -> DataFrame:
    """A venue with events stays; events still to come are told apart."""
    upcoming = F.count_if(F.col("event_datetime") >= moment(as_of)).alias("_upcoming")
    events = t["event"].groupBy("venue_id").agg(F.count("*").alias("_events"), upcoming)
    known = t["venue"].select("venue_id", F.lit(True).alias("_known"))
    found = ids.join(known, "venue_id", "left").join(events, "venue_id", "left")
    return judged(
        found,
        [
            (F.col("_known").isNull(), "unknown_venue"),
            (_yes(F.col("_upcoming") > 0), "active_events"),
            (_yes(F.col("_events") > 0), "has_events"),
        ],
    ).select(
        *ids.columns,
        F.coalesce("_events", F.lit(0)).alias("events"),
        F.coalesce("_upcoming", F.lit(0)).alias("active_events"),
        "accepted",
        "reason",
    )


def check_event_artists(t: Tables, cand: DataFrame) -> DataFrame:
    """Artist and event exist and are not linked yet.

    All three are facts about the pair, so they are looked up once per pair and meet the candidates once.
    """
    pair = ["event_id", "artist_id"]
    artist = t["artist"].select("artist_id", F.lit(True).alias("_artist"))
    event = t["event"].select("event_id", F.lit(True).alias("_event"))
    linked = t["event_artist"].select(*pair, F.lit(True).alias("_linked"))
    facts = (
        cand.groupBy(*pair)
        .agg(F.min("seq").alias("_first"))
        .join(artist, "artist_id", "left")
        .join(event, "event_id", "left")
        .join(linked, pair, "left")
        .select(F.struct(*pair).alias("_pair"), "_first", "_artist", "_event", "_linked")
    )
    found = spread_join(cand.withColumn("_pair", F.struct(*pair)), facts, ["_pair"], "seq")
    return judged(
        found,
        [
            (F.col("_artist").isNull(), "unknown_artist"),
            (F.col("_event").isNull(), "unknown_event"),
            (F.col("_linked").isNotNull() | (F.col("_first") < F.col("seq")), "duplicate_link"),
        ],
    ).select(*cand.columns, "accepted", "reason")


def check_seat_deletes(t: Tables, ids: DataFrame) -> DataFrame:
    """A seat with a ticket stays."""
    known = t["seat"].select("seat_id", F.lit(True).alias("_known"))
    taken = taken_seats(t).withColumn("_taken", F.lit(True))
    found = ids.join(known, "seat_id", "left").join(taken, "seat_id", "left")
    return judged(
        found, [(F.col("_known").isNull(), "unknown_seat"), (F.col("_taken").isNotNull(), "seat_taken")]
    ).select(*ids.columns, "accepted", "reason")


def check_duplicate_tickets(t: Tables, cand: DataFrame) -> DataFrame:
    """No second ticket for an order and category; reports the code that is in the way."""
    pair = ["torder_id", "tcategory_id"]
    old = only_keys_of(t["ticket"], cand, {k: k for k in pair})
    old = old.groupBy(*pair).agg(F.min("ticket_code").alias("existing_code"))
    asked = cand.filter(_all_set(pair)).groupBy(*pair).agg(F.min("seq").alias("_first"))
    known = spread_join(cand, asked.join(old, pair, "left"), pair, "seq")
    taken = F.col("existing_code").isNotNull() | (F.col("_first") < F.col("seq"))
    return judged(known, [(taken, "duplicate_ticket")]).select(
        *cand.columns, "existing_code", "accepted", "reason"
    )


def seat_of(cand: DataFrame) -> Column:
    """The seat asked for, NULL where none is."""
    seat = F.col("seat_id")
    if dict(cand.dtypes)["seat_id"] != "string":
        return seat
    return F.when(~blank(seat) & (seat != NO_SEAT), seat)


def check_seat_free(t: Tables, cand: DataFrame) -> DataFrame:
    """The seat has no ticket; with a ``ticket_id`` in the candidates, no other ticket."""
    asked = cand.withColumn("_seat", seat_of(cand))
    if "ticket_id" not in cand.columns:
        kind = dict(t["has_relationship"].dtypes)["ticket_id"]
        asked = asked.withColumn("ticket_id", F.lit(None).cast(kind))
    existing = t["has_relationship"].select(F.col("seat_id").alias("_seat"), "ticket_id")
    checked = moved(asked, existing, ["_seat"], "ticket_id", F.lit(True))
    taken = F.col("_seat").isNotNull() & F.col("_taken")
    return judged(checked, [(taken, "seat_taken")]).select(*cand.columns, "accepted", "reason")


def seats_with_many_tickets(t: Tables) -> DataFrame:
    counts = t["has_relationship"].groupBy("seat_id").agg(F.count("*").alias("tickets"))
    return counts.filter(F.col("tickets") > 1)


def check_events(cand: DataFrame) -> DataFrame:
    """Title not blank; date and time parse. Adds ``event_datetime``."""
    at = event_moment(F.col("date"), F.col("time"))
    titled = cand.withColumn("_title", strip(F.col("title"))).withColumn("event_datetime", at)
    return judged(
        titled, [(blank(F.col("_title")), "blank_title"), (F.col("event_datetime").isNull(), "bad_date")]
    ).select(*cand.columns, "event_datetime", "accepted", "reason")


def check_event_owner(t: Tables, cand: DataFrame) -> DataFrame:
    """Organizers may change their own events only; administrators all. ``cand``: event_id, user_id, role."""
    owner = t["organizer"].select("organizer_id", F.col("user_id").alias("_owner"))
    event = t["event"].select("event_id", "organizer_id", F.lit(True).alias("_known")).join(owner, "organizer_id", "left")
    found = cand.join(event.drop("organizer_id"), "event_id", "left")
    role = F.col("role")
    admin = _yes(role.isin("administrator", "admin"))
    own = _yes(F.col("_owner") == F.col("user_id"))
    return judged(
        found,
        [
            (~admin & ~_yes(role == "organizer"), "no_access"),
            (F.col("_known").isNull(), "unknown_event"),
            (~admin & ~own, "not_owner"),
        ],
    ).select(*cand.columns, "accepted", "reason")


def quota_facts(t: Tables, cand: DataFrame) -> DataFrame:
    """Quota and sold tickets of the categories that the candidates ask for.

    Tickets are counted before they meet anything, so that the shuffle carries one row per category and task.
    """
    asked = {"category_id": "tcategory_id"}
    categories = only_keys_of(t["ticket_category"], cand, asked).select("category_id", F.col("quota").alias("_quota"))
    facts = categories.join(sold_per_category(t["ticket"]), "category_id", "left")
    return facts.select(
        F.col("category_id").alias("tcategory_id"), "_quota", F.coalesce("sold", F.lit(0)).alias("_sold")
    )


def admit_tickets(t: Tables, cand: DataFrame) -> DataFrame:
    """Tickets are admitted while fewer than the quota of their category are sold."""
    return admit_under_quota(quota_facts(t, cand), t["order"], cand)


def admit_under_quota(facts: DataFrame, order: DataFrame, cand: DataFrame) -> DataFrame:
    """The same with the sold counts given (``tcategory_id, _quota, _sold``), as a stream keeps them.

    Every admitted ticket takes one place, so a row fits exactly if sold tickets plus earlier rows that
    could be admitted stay below the quota. Rows with an unknown order or category take no place.
    """
    orders = only_keys_of(order, cand, {"order_id": "torder_id"})
    orders = orders.select(F.col("order_id").alias("torder_id"), F.lit(True).alias("_order"))
    known = spread_join(cand, facts, ["tcategory_id"], "seq")
    known = spread_join(known, orders, ["torder_id"], "seq")
    fits = F.col("_order").isNotNull() & F.col("_quota").isNotNull()
    counted = running_counts(known, ["tcategory_id"], {"_earlier": fits})
    return judged(
        counted,
        [
            (_yes(F.col("_sold") + F.col("_earlier") >= F.col("_quota")), "quota_full"),
            (F.col("_quota").isNull(), "unknown_category"),
            (F.col("_order").isNull(), "unknown_order"),
        ],
    ).select(*cand.columns, "accepted", "reason")


def promo_facts(t: Tables, cand: DataFrame) -> DataFrame:
    """Limit, window and redemptions so far of the promotions that the candidates ask for."""
    promos = only_keys_of(t["promotion"], cand, {"promotion_id": "promotion_id"})
    used = t["order_promotion"].groupBy("promotion_id").agg(F.count("*").alias("n"))
    return promos.join(used, "promotion_id", "left").select(
        "promotion_id",
        F.col("usage_limit").alias("_limit"),
        F.col("start_date").alias("_start"),
        F.col("end_date").alias("_end"),
        F.coalesce("n", F.lit(0)).alias("_used"),
    )


def order_dates(t: Tables, cand: DataFrame) -> DataFrame:
    """Known orders of the candidates with the day of their earliest event, NULL without tickets."""
    orders = only_keys_of(t["order"], cand, {"order_id": "order_id"}).select("order_id")
    tickets = only_keys_of(t["ticket"], cand, {"torder_id": "order_id"})
    event = t["event"].select(F.col("event_id").alias("tevent_id"), "event_datetime")
    category = t["ticket_category"].select(F.col("category_id").alias("tcategory_id"), "tevent_id")
    dates = (
        tickets.select(F.col("torder_id").alias("order_id"), "tcategory_id")
        .join(category.join(event, "tevent_id"), "tcategory_id")
        .groupBy("order_id")
        .agg(F.to_date(F.min("event_datetime")).alias("_event_date"))
    )
    return orders.join(dates, "order_id", "left").withColumn("_order", F.lit(True))


def admit_redemptions(t: Tables, cand: DataFrame) -> DataFrame:
    """Promotion uses are admitted below the limit and inside the promotion's window."""
    return admit_under_limit(promo_facts(t, cand), order_dates(t, cand), cand)


def admit_under_limit(facts: DataFrame, dates: DataFrame, cand: DataFrame) -> DataFrame:
    """The same with redemptions so far and event days given."""
    known = spread_join(cand, facts, ["promotion_id"], "seq")
    known = spread_join(known, dates, ["order_id"], "seq")
    day = F.col("_event_date")
    outside = _yes((day < F.col("_start")) | (day > F.col("_end")))
    fits = F.col("_limit").isNotNull() & F.col("_order").isNotNull() & ~outside
    counted = running_counts(known, ["promotion_id"], {"_earlier": fits})
    return judged(
        counted,
        [
            (F.col("_limit").isNull(), "unknown_promotion"),
            (F.col("_used") + F.col("_earlier") >= F.col("_limit"), "limit_reached"),
            (outside, "outside_dates"),
            (F.col("_order").isNull(), "unknown_order"),
        ],
    ).select(*cand.columns, "accepted", "reason")
