"""Figures of the administrator and organizer pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.columns import RESERVED, day, moment
from boxoffice.operators.deltas import Kept, rows_after, touched_keys, touched_rows
from boxoffice.operators.spread import side_by_side, spread_join
from boxoffice.operators.tickets import sold_per_category
from boxoffice.schemas import PAID
from boxoffice.sources.tables import Tables


def user_count(t: Tables) -> DataFrame:
    return t["user_account"].agg(F.count("*").alias("user_count"))


def events_this_month(t: Tables, as_of) -> DataFrame:
    first = F.trunc(day(as_of), "month")
    start, end = first.cast("timestamp_ntz"), F.add_months(first, 1).cast("timestamp_ntz")
    stamp = F.col("event_datetime")
    return t["event"].filter((stamp >= start) & (stamp < end)).agg(F.count("*").alias("events_this_month"))


def gross_volume(t: Tables) -> DataFrame:
    paid = t["order"].filter(F.col("payment_status") == PAID)
    return paid.agg(F.coalesce(F.sum("total_amount"), F.lit(0).cast("decimal(22,2)")).alias("gross_volume"))


def running_promo_types(t: Tables, as_of) -> DataFrame:
    """Running promotions and their redemptions by discount type."""
    running = t["promotion"].filter((F.col("start_date") <= day(as_of)) & (F.col("end_date") >= day(as_of)))
    uses = t["order_promotion"].groupBy("promotion_id").agg(F.count("*").alias("uses"))
    return (
        running.join(uses, "promotion_id", "left")
        .groupBy("discount_type")
        .agg(F.count("*").alias("running_promos"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"))
    )


def venue_figures(t: Tables) -> DataFrame:
    return t["venue"].agg(
        F.count("*").alias("venues"),
        F.count_if(F.col("jenis_seating") == RESERVED).alias("reserved_venues"),
        F.coalesce(F.max("capacity"), F.lit(0)).alias("largest_capacity"),
    )


def admin_dashboard(t: Tables, as_of) -> DataFrame:
    """All figures of the administrator page in one row."""
    promos = running_promo_types(t, as_of).agg(
        F.coalesce(F.sum("running_promos"), F.lit(0)).alias("running_promos"),
        F.coalesce(F.sum("uses"), F.lit(0)).alias("promo_uses"),
    )
    return side_by_side(
        user_count(t), events_this_month(t, as_of), gross_volume(t), promos, venue_figures(t)
    )


PAID_SALES = Kept(["event_id"], {"revenue": "price"})


def sale_rows(tickets: DataFrame, order: DataFrame, ticket_category: DataFrame) -> DataFrame:
    """``(event_id, price)`` of the tickets in paid orders."""
    paid = order.filter(F.col("payment_status") == PAID).select(F.col("order_id").alias("torder_id"))
    categories = ticket_category.select(F.col("category_id").alias("tcategory_id"), F.col("tevent_id").alias("event_id"), F.col("price").cast("decimal(28,2)").alias("price"))
    sold = spread_join(tickets.select("tcategory_id", "torder_id"), paid, ["torder_id"], how="left_semi")
    return spread_join(sold, categories, ["tcategory_id"], how="inner").select("event_id", "price")


def paid_sales(t: Tables) -> DataFrame:
    """Tickets in paid orders per event, as a figure to be kept: ``(event_id, rows, revenue)``."""
    return PAID_SALES.of(sale_rows(t["ticket"], t["order"], t["ticket_category"]))


def refreshed_paid_sales(t: Tables, stored: DataFrame, change) -> DataFrame:
    """`paid_sales` after a change set, from those before it. Only tickets are looked at that the change set
    touches, whose category it does, or whose order becomes paid or is no longer."""
    if "ticket" in change.rewrites:
        return _sales_with_tickets(t, stored, change)
    category = lambda rows: rows.select("category_id", F.col("tevent_id").alias("event_id"), F.col("price").cast("decimal(28,2)").alias("price"))
    sold, signed = None, []
    if "order" in change.rewrites:
        sold = _newly_paid(t, change)
        signed.append(spread_join(category(t["ticket_category"]), sold, ["category_id"], how="inner"))
    if "ticket_category" in change.rewrites:
        keys = touched_keys(change, "ticket_category")
        tickets = t.lookup("ticket", {"tcategory_id": "category_id"}, keys).select("tcategory_id", "torder_id")
        paid = t["order"].filter(F.col("payment_status") == PAID).select(F.col("order_id").alias("torder_id"))
        known = sold_per_category(spread_join(tickets, paid, ["torder_id"], how="left_semi"))
        now = known if sold is None else known.unionByName(sold).groupBy("category_id").agg(F.sum("sold").alias("sold"))
        before, after = touched_rows(t, change, "ticket_category")
        prices = category(before).withColumn("_times", F.lit(-1)).unionByName(category(after).withColumn("_times", F.lit(1)))
        signed.append(prices.join(now, "category_id").withColumn("sold", F.col("sold") * F.col("_times")))
    if not signed:
        return stored
    rows = reduce(DataFrame.unionByName, [part.select("event_id", "price", F.col("sold").alias("_sign")) for part in signed])
    return PAID_SALES.moved(stored, rows)


def _newly_paid(t: Tables, change) -> DataFrame:
    """``(category_id, sold)``: tickets per category in orders that become paid, less those in orders that are no longer."""
    flagged = [rows.select(F.col("order_id").alias("torder_id"), (F.col("payment_status") == PAID).alias("_paid")) for rows in touched_rows(t, change, "order")]
    was, now = (F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) for c in ("_was", "_now"))
    none = F.lit(None).cast("boolean")
    before, after = flagged[0].select("torder_id", F.col("_paid").alias("_was"), none.alias("_now")), flagged[1].select("torder_id", none.alias("_was"), F.col("_paid").alias("_now"))
    turned = before.unionByName(after).groupBy("torder_id").agg((now - was).alias("_turn")).filter("_turn <> 0")
    tickets = spread_join(t["ticket"].select("tcategory_id", "torder_id"), turned, ["torder_id"], how="inner")
    return tickets.groupBy(F.col("tcategory_id").alias("category_id")).agg(F.sum("_turn").alias("sold")).filter("sold <> 0")


def _sales_with_tickets(t: Tables, stored: DataFrame, change) -> DataFrame:
    """`refreshed_paid_sales` after a change set that also touches tickets."""
    ids = [touched_keys(change, "ticket")]
    for parent, column in (("order", "torder_id"), ("ticket_category", "tcategory_id")):
        if parent in change.rewrites:
            keys = touched_keys(change, parent)
            ids.append(t.lookup("ticket", {column: keys.columns[0]}, keys).select("ticket_id"))
    affected, by_id = reduce(DataFrame.unionByName, ids).distinct(), {"ticket_id": "ticket_id"}

    def sales(rows_of) -> DataFrame:
        rows = rows_of("ticket", by_id, affected)
        return sale_rows(rows, rows_of("order", {"order_id": "torder_id"}, rows), rows_of("ticket_category", {"category_id": "tcategory_id"}, rows))

    return PAID_SALES.after(stored, sales(t.lookup), sales(lambda *asked: rows_after(t, change, *asked)))


def _paid_sales(t: Tables) -> DataFrame:
    """Tickets in paid orders per event: number and price."""
    paid = t["order"].filter(F.col("payment_status") == PAID).select(F.col("order_id").alias("torder_id"))
    sold = sold_per_category(t["ticket"].join(paid, "torder_id", "left_semi"))
    return (
        t["ticket_category"]
        .join(sold, "category_id")
        .groupBy(F.col("tevent_id").alias("event_id"))
        .agg(
            F.sum("sold").alias("tickets_sold"),
            F.sum((F.col("price") * F.col("sold")).cast("decimal(28,2)")).alias("revenue"),
        )
    )


def organizer_dashboard(t: Tables, as_of, kept_sales: DataFrame | None = None) -> DataFrame:
    """Per organizer: events to come, tickets sold, revenue and distinct venues. ``kept_sales`` are those of `paid_sales`."""
    sales = _paid_sales(t) if kept_sales is None else kept_sales.withColumnRenamed("rows", "tickets_sold")
    upcoming = (F.col("event_datetime") >= moment(as_of)).cast("long")
    figures = (
        t["event"]
        .select("event_id", "organizer_id", upcoming.alias("upcoming"))
        .join(sales, "event_id", "left")
        .groupBy("organizer_id")
        .agg(
            F.sum("upcoming").alias("active_events"),
            F.coalesce(F.sum("tickets_sold"), F.lit(0)).alias("tickets_sold"),
            F.coalesce(F.sum("revenue"), F.lit(0)).cast("decimal(38,2)").alias("revenue"),
        )
    )
    venues = t["event"].groupBy("organizer_id").agg(F.countDistinct("venue_id").alias("partner_venues"))
    zero = F.lit(0)
    return (
        t["organizer"]
        .select("organizer_id", "organizer_name")
        .join(figures, "organizer_id", "left")
        .join(venues, "organizer_id", "left")
        .select(
            "organizer_id",
            "organizer_name",
            F.coalesce("active_events", zero).alias("active_events"),
            F.coalesce("tickets_sold", zero).alias("tickets_sold"),
            F.coalesce("revenue", zero.cast("decimal(38,2)")).alias("revenue"),
            F.coalesce("partner_venues", zero).alias("partner_venues"),
        )
    )


def organizer_event_list(t: Tables) -> DataFrame:
    """Title and time of each organizer's events."""
    return t["event"].select("organizer_id", "event_id", "event_title", "event_datetime").orderBy(
        "organizer_id", "event_datetime", "event_id"
    )
