"""Tickets, quotas and seats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.functions.columns import (
    DASH,
    FREE,
    NO_SEAT,
    NO_SEAT_LABEL,
    RESERVED,
    TAKEN,
    USED,
    VALID,
    category_label,
    day_display,
    equals,
    moment,
    moment_display,
    narrowed,
    seat_label,
    ticket_status,
    weekday_display,
    whole_display,
)
from boxoffice.operators.deltas import Kept, rows_after, touched_keys
from boxoffice.operators.observed import with_totals
from boxoffice.operators.spread import only_keys_of, repeated, side_by_side, spread_join
from boxoffice.sources.tables import Tables

SEAT_ORDER = ["section", "row_number", "seat_number", "seat_id"]


def _orders_in_scope(t: Tables, role: str, user_id: object | None) -> DataFrame:
    """Order id and customer name; a customer sees own orders only."""
    customer = t["customer"]
    if role == "customer":
        customer = customer.filter(F.col("user_id") == F.lit(user_id))
    return t["order"].select("order_id", "customer_id").join(
        customer.select("customer_id", F.col("full_name").alias("customer_name")), "customer_id"
    )


def _category_places(t: Tables) -> DataFrame:
    """Each category with its event and venue."""
    event = t["event"].select(F.col("event_id").alias("tevent_id"), "event_title", "event_datetime", "venue_id")
    venue = t["venue"].select("venue_id", "venue_name", "city", "jenis_seating")
    return t["ticket_category"].join(event, "tevent_id").join(venue, "venue_id")


def ticket_register(t: Tables, role: str, user_id: object | None = None) -> DataFrame:
    """Tickets with customer, event, price, place and status, newest event first."""
    return _register_rows(t, role, user_id).orderBy(F.desc("event_datetime"), "ticket_code", "ticket_id")


def _register_rows(t: Tables, role: str, user_id: object | None) -> DataFrame:
    orders = _orders_in_scope(t, role, user_id).select(F.col("order_id").alias("torder_id"), "customer_name")
    places = _category_places(t).withColumnRenamed("category_id", "tcategory_id")
    status = ticket_status(t["ticket"].columns)
    return (
        t["ticket"]
        .select("ticket_id", "ticket_code", "tcategory_id", "torder_id", status.alias("status"))
        .join(places, "tcategory_id")
        .join(orders, "torder_id")
        .select(
            *["ticket_id", "ticket_code", "customer_name", "event_title", "category_name", "price"],
            *["venue_name", "city", "event_datetime", "torder_id", "status"],
        )
    )


def register_report(t: Tables, role: str, user_id: object | None = None) -> tuple[DataFrame, DataFrame]:
    """`ticket_register`, unsorted, as a table, and `ticket_status_summary`, from one pass."""
    totals = {
        "total_tickets": F.count(F.lit(1)),
        "valid_tickets": F.count_if(F.col("status") == VALID),
        "used_tickets": F.count_if(F.col("status") == USED),
    }
    return with_totals(_register_rows(t, role, user_id), "register", **totals)


def register_display(register: DataFrame) -> DataFrame:
    """The register as the pages print it: times, days and prices as text."""
    at = F.col("event_datetime").cast("timestamp_ntz")
    return register.select(
        *["ticket_id", "ticket_code", "event_title"],
        moment_display(at).alias("starts"),
        weekday_display(at).alias("day_for_customers"),
        day_display(at).alias("day_for_organizers"),
        F.concat(F.lit("Rp "), whole_display(F.col("price"))).alias("price"),
    )


def ticket_status_summary(t: Tables, role: str, user_id: object | None = None) -> DataFrame:
    """Counts of the register. Only the existence of the joined rows matters, so all joins are semi joins."""
    order = t["order"]
    customer = t["customer"]
    if role == "customer":
        customer = customer.filter(F.col("user_id") == F.lit(user_id))
    order = order.join(customer.select("customer_id"), "customer_id", "left_semi")
    event = t["event"].join(t["venue"].select("venue_id"), "venue_id", "left_semi")
    category = t["ticket_category"].join(
        event.select(F.col("event_id").alias("tevent_id")), "tevent_id", "left_semi"
    )
    status = ticket_status(t["ticket"].columns)
    counted = (
        t["ticket"]
        .select("tcategory_id", "torder_id", status.alias("word"))
        .join(category.select(F.col("category_id").alias("tcategory_id")), "tcategory_id", "left_semi")
        .join(order.select(F.col("order_id").alias("torder_id")), "torder_id", "left_semi")
    )
    return counted.agg(
        F.count("*").alias("total_tickets"),
        F.count_if(F.col("word") == VALID).alias("valid_tickets"),
        F.count_if(F.col("word") == USED).alias("used_tickets"),
    )


def sold_per_category(tickets: DataFrame) -> DataFrame:
    """Counts before any join, so that a category with very many tickets is one row from there on."""
    return tickets.groupBy(F.col("tcategory_id").alias("category_id")).agg(F.count("*").alias("sold"))


SOLD = Kept(["tcategory_id"])


def kept_sold(t: Tables) -> DataFrame:
    """`sold_per_category` as a figure to be kept: ``(tcategory_id, rows)``."""
    return SOLD.of(t["ticket"])


def refreshed_sold(t: Tables, stored: DataFrame, change) -> DataFrame:
    """`kept_sold` after a change set, from the tickets that it touches."""
    if "ticket" not in change.rewrites:
        return stored
    keys, by_id = touched_keys(change, "ticket"), {"ticket_id": "ticket_id"}
    return SOLD.after(stored, t.lookup("ticket", by_id, keys), rows_after(t, change, "ticket", by_id, keys))


def category_utilisation(t: Tables, sold: DataFrame | None = None) -> DataFrame:
    """Sold tickets against quota per category, with the label of the ticket form. ``sold`` is that of `kept_sold`."""
    used = F.coalesce("sold", F.lit(0))
    counts = sold_per_category(t["ticket"]) if sold is None else sold.toDF("category_id", "sold")
    rows = (
        _category_places(t)
        .join(counts, "category_id", "left")
        .select("category_id", "category_name", "price", "quota", "tevent_id", "jenis_seating", used.alias("used"))
    )
    return rows.select(
        "category_id",
        category_label().alias("display"),
        F.col("tevent_id").alias("event_id"),
        "category_name",
        "quota",
        "used",
        (F.col("jenis_seating") == RESERVED).alias("has_seat"),
        (F.col("used") >= F.col("quota")).alias("is_full"),
    ).orderBy("category_name", "category_id")


def remaining_quota(t: Tables, event_id: object | None = None) -> DataFrame:
    """Quota left per category, of one event or of all. An unknown event is an error."""
    categories = t["ticket_category"]
    if event_id is not None:
        if t["event"].filter(equals("event_id", event_id)).isEmpty():
            raise ValueError(f"no event {event_id}")
        categories = categories.filter(equals("tevent_id", event_id))
    tickets = t["ticket"]
    if event_id is not None:
        wanted = categories.select(F.col("category_id").alias("tcategory_id"))
        tickets = tickets.join(wanted, "tcategory_id", "left_semi")
    return categories.join(sold_per_category(tickets), "category_id", "left").select(
        "tevent_id",
        "category_id",
        "category_name",
        (F.col("quota") - F.coalesce("sold", F.lit(0))).cast("int").alias("remaining"),
    )


def next_tickets(t: Tables, as_of, n: int = 2) -> DataFrame:
    """The next ``n`` tickets of each customer.

    Ranked twice, per order and per customer: the bound is a constant, so each rank is cut down before
    its shuffle, and an order with very many tickets reaches the join with ``n`` of them per task.
    """
    coming = _category_places(t).filter(F.col("event_datetime") >= moment(as_of))
    coming = coming.select(
        F.col("category_id").alias("tcategory_id"), "category_name", "event_title", "event_datetime", "venue_name"
    )
    tickets = t["ticket"].select("ticket_id", "tcategory_id", F.col("torder_id").alias("order_id"))
    dated = tickets.join(coming, "tcategory_id")
    soonest = [F.asc("event_datetime"), F.asc("ticket_id")]
    per_order = _first_n(dated, "order_id", soonest, n).drop("place")
    owned = per_order.join(t["order"].select("order_id", "customer_id"), "order_id")
    return _first_n(owned, "customer_id", soonest, n).select(
        "customer_id", "place", "ticket_id", "event_title", "event_datetime", "venue_name", "category_name"
    )


def _first_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("place") <= n)


def taken_seats(t: Tables) -> DataFrame:
    return t["has_relationship"].select("seat_id").distinct()


def _free(t: Tables) -> DataFrame:
    return t["seat"].join(taken_seats(t), "seat_id", "left_anti")


def free_seats(t: Tables, venue_id: object | None = None) -> DataFrame:
    return (
        narrowed(_free(t), equals("venue_id", venue_id))
        .orderBy(*SEAT_ORDER)
        .select("seat_id", seat_label(DASH).alias("display"), "venue_id")
    )


def seat_inventory(t: Tables) -> DataFrame:
    """Seats with their state; a seat with several tickets is listed once per ticket.

    Tickets are counted per seat, so a seat is one row through the joins and the sort, however many tickets it
    has, and is only repeated in the sorted rows.
    """
    tickets = t["has_relationship"].groupBy("seat_id").agg(F.count("*").alias("_tickets"))
    venue = t["venue"].select("venue_id", "venue_name")
    status = F.when(F.col("_tickets").isNull(), FREE).otherwise(TAKEN)
    seats = t["seat"].join(tickets, "seat_id", "left").join(venue, "venue_id").orderBy("venue_name", *SEAT_ORDER)
    listed = ["seat_id", "section", "row_number", "seat_number", "venue_name", status.alias("status"), "venue_id"]
    return repeated(seats, F.coalesce("_tickets", F.lit(1))).select(*listed)


def seat_totals(t: Tables) -> DataFrame:
    """Seats, links and their difference. Links are counted as they are, not per seat."""
    totals = side_by_side(
        t["seat"].agg(F.count("*").alias("total_seats")),
        t["has_relationship"].agg(F.count("*").alias("taken_seats")),
    )
    return totals.withColumn("free_seats", F.col("total_seats") - F.col("taken_seats"))


def checkout_seats(t: Tables, n: int = 24) -> DataFrame:
    """Seats on offer per event: the first ``n`` free seats of a reserved venue, else one row without seat."""
    events = t["event"].select("event_id", "venue_id")
    seating = t["venue"].select("venue_id", "jenis_seating")
    placed = events.join(seating, "venue_id")
    reserved = F.coalesce(F.col("jenis_seating") == RESERVED, F.lit(False))

    seats = only_keys_of(_free(t), placed.filter(reserved), {"venue_id": "venue_id"})
    offered = _first_n(seats, "venue_id", [F.asc(c) for c in SEAT_ORDER], n)
    lists = offered.groupBy("venue_id").agg(
        F.collect_list(F.struct("place", "seat_id", seat_label(" - ").alias("label"))).alias("seats")
    )
    with_seats = spread_join(placed.filter(reserved), lists, ["venue_id"], "event_id", "inner")
    with_seats = with_seats.select("event_id", F.explode("seats").alias("s")).select(
        "event_id", "s.place", F.col("s.seat_id").cast("string").alias("seat_id"), "s.label"
    )
    without = placed.filter(~reserved).select(
        "event_id", F.lit(1).alias("place"), F.lit(NO_SEAT).alias("seat_id"), F.lit(NO_SEAT_LABEL).alias("label")
    )
    return with_seats.unionByName(without).orderBy("event_id", "place")
