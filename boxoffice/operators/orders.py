"""Orders, promotions and the checkout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.columns import (
    QUANTITY_LIMIT,
    blank,
    day,
    day_text,
    discounted,
    initial,
    literal_match,
    moment,
    narrowed,
    order_label,
    shortened,
    stable_uuid,
    time_text,
)
from boxoffice.operators.intervals import with_intervals
from boxoffice.operators.observed import with_totals
from boxoffice.operators.spread import only_keys_of, spread_join
from boxoffice.schemas import PAID, PENDING
from boxoffice.sources.tables import Tables

ADMIN_ROLES = ("administrator", "admin")


def order_ledger(t: Tables) -> DataFrame:
    """Orders with customer and user name, newest first."""
    return _ledger_rows(t).orderBy(F.desc("order_date"), "order_id")


LEDGER = ["order_id", "order_date", "payment_status", "total_amount", "customer_name", "customer_username"]


def _customers(t: Tables) -> DataFrame:
    users = t["user_account"].select("user_id", F.col("username").alias("customer_username"))
    return t["customer"].select("customer_id", "user_id", F.col("full_name").alias("customer_name")).join(users, "user_id").drop("user_id")


def _ledger_rows(t: Tables) -> DataFrame:
    return t["order"].join(_customers(t), "customer_id").select(*LEDGER)


def order_search(t: Tables, q: str | None = None, status: str | None = None) -> DataFrame:
    """Ledger rows whose order id or customer name holds ``q``, in one status if that is given."""
    rows = narrowed(
        _ledger_rows(t).withColumn("_id_text", F.col("order_id").cast("string")),
        literal_match(q, "_id_text", "customer_name"),
        None if not status else F.col("payment_status") == status,
    )
    return rows.drop("_id_text").orderBy(F.desc("order_date"), "order_id")


def _order_figures(role: str) -> dict[str, Column]:
    paid = F.col("payment_status") == PAID
    revenue = F.lit(0).cast("decimal(22,2)")
    if role in (*ADMIN_ROLES, "organizer"):
        revenue = F.coalesce(F.sum(F.when(paid, F.col("total_amount"))), revenue)
    return {
        "total_orders": F.count(F.lit(1)),
        "paid_orders": F.count_if(paid),
        "pending_orders": F.count_if(F.col("payment_status") == PENDING),
        "total_revenue": revenue if role in (*ADMIN_ROLES, "organizer") else F.max(revenue),
    }


def order_totals(t: Tables, role: str) -> DataFrame:
    """Orders in all, paid and pending in one pass; revenue only for those who may see it."""
    return t["order"].agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in _order_figures(role).items()])


def order_report(t: Tables, role: str) -> tuple[DataFrame, DataFrame]:
    """`order_ledger`, unsorted, as a table, and `order_totals`, from one pass over the orders. Orders whose customer
    is not there are counted, but not listed."""
    named = _customers(t).withColumn("_listed", F.lit(True))
    rows = spread_join(t["order"], named, ["customer_id"], "order_id").select(*LEDGER, F.coalesce("_listed", F.lit(False)).alias("_listed"))
    written, totals = with_totals(rows, "ledger", **{n: F.coalesce(c, F.lit(0)) for n, c in _order_figures(role).items()})
    return written.filter("_listed").drop("_listed"), totals


def ledger_display(ledger: DataFrame) -> DataFrame:
    """The ledger as the page prints it: cut id, initial of the user, time without seconds."""
    return ledger.select(
        "order_id",
        shortened(F.col("order_id").cast("string"), 13).alias("short_id"),
        initial(F.col("customer_username"), "G").alias("initial"),
        F.coalesce(F.nullif("customer_name", F.lit("")), F.lit("Guest")).alias("customer_name"),
        F.concat_ws(" ", day_text(F.col("order_date")), time_text(F.col("order_date"))).alias("ordered_at"),
        "payment_status",
        "total_amount",
    )


def paid_order_event(t: Tables) -> DataFrame:
    """Each paid order with the earliest event of its tickets."""
    category = t["ticket_category"].select(F.col("category_id").alias("tcategory_id"), "tevent_id")
    event = t["event"].select(F.col("event_id").alias("tevent_id"), "event_datetime", "event_title")
    paid = t["order"].filter(F.col("payment_status") == PAID).select("order_id", "customer_id")
    bought = only_keys_of(t["ticket"], paid, {"torder_id": "order_id"})
    dated = bought.select("tcategory_id", F.col("torder_id").alias("order_id")).join(
        category.join(event, "tevent_id"), "tcategory_id"
    )
    first = dated.groupBy("order_id").agg(F.min(F.struct("event_datetime", "tevent_id", "event_title")).alias("e"))
    name = t["customer"].select("customer_id", "full_name")
    title = F.col("e.event_title").alias("event_title")
    rows = paid.join(first, "order_id").join(name, "customer_id")
    rows = rows.select("order_id", "full_name", F.col("e.tevent_id").alias("event_id"), title)
    return rows.withColumn("display", order_label()).orderBy("order_id")


def unexpired_promo_count(t: Tables, as_of) -> DataFrame:
    return t["promotion"].agg(F.count_if(F.col("end_date") >= day(as_of)).alias("promo_count"))


def _running(t: Tables, as_of) -> DataFrame:
    return t["promotion"].filter((F.col("start_date") <= day(as_of)) & (F.col("end_date") >= day(as_of)))


def running_promotions(t: Tables, as_of) -> DataFrame:
    return (
        _running(t, as_of)
        .select("promotion_id", "promo_code", "discount_type", "discount_value", "start_date", "end_date")
        .orderBy(F.desc("start_date"), "promotion_id")
    )


def running_promotions_by_day(t: Tables, days: DataFrame) -> DataFrame:
    """The promotions that run on each of the distinct ``days(day)``."""
    shown = t["promotion"].select("promotion_id", "promo_code", "discount_type", "discount_value", "start_date", "end_date")
    return with_intervals(days.select("day").distinct(), "day", shown, "start_date", "end_date")


def _use_counts(t: Tables) -> DataFrame:
    return t["order_promotion"].groupBy("promotion_id").agg(F.count("order_promotion_id").alias("uses"))


def promotion_usage(t: Tables) -> DataFrame:
    """Every promotion with its redemptions, newest first."""
    return (
        t["promotion"]
        .join(_use_counts(t), "promotion_id", "left")
        .select(
            *["promotion_id", "promo_code", "discount_type", "discount_value", "start_date", "end_date"],
            "usage_limit",
            F.coalesce("uses", F.lit(0)).alias("current_usage"),
        )
        .orderBy(F.desc("start_date"), "promotion_id")
    )


def promotion_totals(t: Tables) -> DataFrame:
    return promotion_usage(t).agg(
        F.count("*").alias("total_promos"),
        F.coalesce(F.sum("current_usage"), F.lit(0)).alias("total_uses"),
        F.count_if(F.col("discount_type") == "PERCENTAGE").alias("percentage_promos"),
    )


def promo_search(t: Tables, q: str | None = None) -> DataFrame:
    return narrowed(promotion_usage(t), literal_match(q, "promo_code"))


def price_carts(t: Tables, carts: DataFrame, as_of) -> DataFrame:
    """Prices carts (``cart_id, event_id, category_name, quantity, promo_code, …``) or says why not.

    A category name that occurs twice in an event counts at its lowest price. The promotion has to run
    on ``as_of``. Reasons, first one wins: unknown_category, bad_quantity, bad_promo.
    """
    prices = (
        only_keys_of(
            t["ticket_category"].withColumnRenamed("tevent_id", "event_id"),
            carts,
            {"event_id": "event_id", "category_name": "category_name"},
        )
        .groupBy("event_id", "category_name")
        .agg(F.min("price").alias("unit_price"))
    )
    promos = _running(t, as_of).select("promo_code", "discount_type", "discount_value")

    priced = spread_join(carts, prices, ["event_id", "category_name"], "cart_id")
    priced = spread_join(priced, promos, ["promo_code"], "cart_id")
    quantity = F.col("quantity")
    reason = (
        F.when(F.col("unit_price").isNull(), "unknown_category")
        .when(quantity.isNull() | (quantity <= 0) | (quantity > QUANTITY_LIMIT), "bad_quantity")
        .when(~blank(F.col("promo_code")) & F.col("discount_type").isNull(), "bad_promo")
    )
    base = F.col("unit_price") * quantity
    total = F.when(F.col("discount_type").isNull(), base).otherwise(
        discounted(base, F.col("discount_type"), F.col("discount_value"))
    )
    return (
        priced.withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .withColumn("base_price", F.when(F.col("accepted"), base.cast("decimal(14,2)")))
        .withColumn("total_price", F.when(F.col("accepted"), F.round(total, 2).cast("decimal(14,2)")))
        .select(*carts.columns, "base_price", "total_price", "accepted", "reason")
    )


def placed_orders(priced: DataFrame, as_of, batch: str) -> DataFrame:
    """Order rows of the accepted carts: pending, dated ``as_of``, id from batch and cart."""
    return priced.filter("accepted").select(
        stable_uuid(F.lit("order"), F.lit(batch), F.col("cart_id")).alias("order_id"),
        moment(as_of).alias("order_date"),
        F.lit(PENDING).alias("payment_status"),
        F.col("total_price").cast("decimal(12,2)").alias("total_amount"),
        "customer_id",
    )
