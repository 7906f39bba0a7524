"""Users, roles, customers and organizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.columns import ROLE_RANK, moment, or_else, spend_text
from boxoffice.sources.tables import Tables


def _role_rank(role: Column) -> Column:
    rank = F.lit(len(ROLE_RANK))
    for place, name in reversed(list(enumerate(ROLE_RANK))):
        rank = F.when(role == name, F.lit(place)).otherwise(rank)
    return rank


def primary_role(t: Tables) -> DataFrame:
    """One role per user, the highest in rank; users without a role are guests."""
    named = t["account_role"].join(t["role"], "role_id").select("user_id", F.lower("role_name").alias("role"))
    best = named.groupBy("user_id").agg(
        F.min(F.struct(_role_rank(F.col("role")).alias("rank"), F.col("role"))).alias("best")
    )
    return (
        t["user_account"]
        .select("user_id")
        .join(best, "user_id", "left")
        .select("user_id", F.coalesce("best.role", F.lit("guest")).alias("role"))
    )


def user_profile(t: Tables) -> DataFrame:
    """Account, customer and organizer attributes of each user, with the names that the pages show."""
    customer = t["customer"].select("user_id", "customer_id", "full_name", "phone_number")
    organizer = t["organizer"].select("user_id", "organizer_id", "organizer_name", "contact_email")
    users = (
        t["user_account"]
        .select("user_id", "username")
        .join(primary_role(t), "user_id")
        .join(customer, "user_id", "left")
        .join(organizer, "user_id", "left")
    )
    role = F.col("role")
    page_role = F.when(role == "administrator", "admin").when(role == "organizer", "organizer").otherwise("customer")
    own_name = (
        F.when(role == "customer", F.coalesce("full_name", F.lit("User")))
        .when(role == "organizer", F.coalesce("organizer_name", F.lit("User")))
        .otherwise(F.col("username"))
    )
    return users.select(
        "user_id",
        "username",
        "role",
        page_role.alias("page_role"),
        F.initcap("role").alias("role_title"),
        "customer_id",
        "full_name",
        or_else(F.col("phone_number"), F.lit("-")).alias("phone_number"),
        "organizer_id",
        "organizer_name",
        "contact_email",
        F.when(page_role == "organizer", F.col("organizer_name"))
        .otherwise(or_else(F.col("full_name"), F.col("username")))
        .alias("display_name"),
        own_name.alias("page_name"),
    )


def order_count(t: Tables) -> DataFrame:
    """Orders per customer. ``order_id`` is the key of the table, so a plain count is the distinct count."""
    counts = t["order"].groupBy("customer_id").agg(F.count("order_id").alias("order_count"))
    return (
        t["customer"]
        .select("customer_id")
        .join(counts, "customer_id", "left")
        .select("customer_id", F.coalesce("order_count", F.lit(0)).alias("order_count"))
    )


def customer_spend(t: Tables) -> DataFrame:
    """Sum of all orders per customer, whatever their status, with the short label of the dashboard."""
    sums = t["order"].groupBy("customer_id").agg(F.sum("total_amount").alias("spend"))
    total = F.coalesce("spend", F.lit(0).cast("decimal(22,2)"))
    return (
        t["customer"]
        .select("customer_id")
        .join(sums, "customer_id", "left")
        .select("customer_id", total.alias("spend"), spend_text(total).alias("spend_text"))
    )


def active_ticket_count(t: Tables, as_of) -> DataFrame:
    """Tickets of each customer for events on or after ``as_of``; zero for customers without any."""
    coming = t["event"].filter(F.col("event_datetime") >= moment(as_of)).select(F.col("event_id").alias("tevent_id"))
    categories = (
        t["ticket_category"]
        .join(coming, "tevent_id", "left_semi")
        .select(F.col("category_id").alias("tcategory_id"))
    )
    per_order = (
        t["ticket"]
        .join(categories, "tcategory_id", "left_semi")
        .groupBy(F.col("torder_id").alias("order_id"))
        .agg(F.count("*").alias("tickets"))
    )
    per_customer = (
        t["order"]
        .select("order_id", "customer_id")
        .join(per_order, "order_id")
        .groupBy("customer_id")
        .agg(F.sum("tickets").alias("tickets"))
    )
    return (
        t["customer"]
        .select("customer_id")
        .join(per_customer, "customer_id", "left")
        .select("customer_id", F.coalesce("tickets", F.lit(0)).alias("active_tickets"))
    )


def organizer_event_count(t: Tables) -> DataFrame:
    counts = t["event"].groupBy("organizer_id").agg(F.count("*").alias("event_count"))
    return (
        t["organizer"]
        .select("organizer_id", "organizer_name")
        .join(counts, "organizer_id", "left")
        .select("organizer_id", "organizer_name", F.coalesce("event_count", F.lit(0)).alias("event_count"))
    )


def organizers_of(t: Tables, user_id: object) -> DataFrame:
    return t["organizer"].filter(F.col("user_id") == F.lit(user_id)).select("organizer_id")

