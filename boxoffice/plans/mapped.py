"""The box-office tables as views of the star-schema test tables, in Spark and as SQL.

Events are the brand and type pairs of parts, ticket categories the parts, orders and their lines the
orders and tickets, customers also own the venues, suppliers are organizers, artists and promotions.
Views read whole tables, but for two whose filter is part of the mapping, alike in SQL: a line has a seat
if it was returned ("A"), and used a promotion if it has a discount. Ids keep the type of their source.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.sources.tables import Tables

ROLES = "SELECT * FROM VALUES (1, 'Administrator'), (2, 'ORGANIZER'), (3, 'customer') AS v(role_id, role_name)"

EVENT_ID = "concat_ws(' ', p_brand, p_type)"
TICKET_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, unix_date(cast(l_shipdate AS date)))"

# Per table: source, select list, and an optional filter; joins and unions are spelled out below.
_VIEWS = {
    "user_account": (
        "customer",
        ["c_custkey AS user_id", "replace(c_name, '#', '') AS username", "c_name AS password"],
    ),
    "customer": (
        "customer",
        [
            "c_custkey AS customer_id",
            "c_name AS full_name",
            "if(c_acctbal < 0, NULL, concat('+62', c_custkey)) AS phone_number",
            "c_custkey AS user_id",
        ],
    ),
    "organizer": (
        "supplier",
        [
            "s_suppkey AS organizer_id",
            "s_name AS organizer_name",
            "concat(lower(replace(s_name, '#', '')), '@example.com') AS contact_email",
            "s_suppkey AS user_id",
        ],
    ),
    "seat": (
        "orders",
        [
            "o_orderkey AS seat_id",
            "o_orderpriority AS section",
            "cast(o_orderkey AS string) AS seat_number",
            "o_orderstatus AS row_number",
            "o_custkey AS venue_id",
        ],
    ),
    "ticket_category": (
        "part",
        [
            "p_partkey AS category_id",
            "p_name AS category_name",
            "p_size AS quota",
            "cast(p_retailprice AS decimal(12,2)) AS price",
            f"{EVENT_ID} AS tevent_id",
        ],
    ),
    "order": (
        "orders",
        [
            "o_orderkey AS order_id",
            "o_orderdate AS order_date",
            "CASE o_orderstatus WHEN 'F' THEN 'LUNAS' WHEN 'O' THEN 'PENDING' ELSE 'DIBATALKAN' END AS payment_status",
            "cast(o_totalprice AS decimal(12,2)) AS total_amount",
            "o_custkey AS customer_id",
        ],
    ),
    "ticket": (
        "lineitem",
        [
            f"{TICKET_ID} AS ticket_id",
            f"concat('TTK-', {TICKET_ID}) AS ticket_code",
            "l_partkey AS tcategory_id",
            "l_orderkey AS torder_id",
            "CASE l_returnflag WHEN 'A' THEN ' terpakai ' WHEN 'R' THEN 'Void' END AS status",
        ],
    ),
    "promotion": (
        "supplier",
        [
            "s_suppkey AS promotion_id",
            "concat('PROMO', s_suppkey) AS promo_code",
            "if(s_nationkey % 2 = 0, 'PERCENTAGE', 'NOMINAL') AS discount_type",
            "cast(if(s_nationkey % 2 = 0, 5 + s_nationkey, abs(s_acctbal)) AS decimal(12,2)) AS discount_value",
            "date_add(date'1995-01-01', s_nationkey * 60) AS start_date",
            "date_add(date'1996-01-01', s_nationkey * 75) AS end_date",
            "100 + s_nationkey * 40 AS usage_limit",
        ],
    ),
}


def mapped_tables(spark: SparkSession, sf_dir: str) -> Tables:
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def view(source: str, columns: list[str]) -> DataFrame:
        return read(source).selectExpr(*columns)

    def account_role() -> DataFrame:
        by_segment = read("customer").selectExpr(
            "CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'HOUSEHOLD' THEN 3 "
            "WHEN 'AUTOMOBILE' THEN 3 END AS role_id",
            "c_custkey AS user_id",
        )
        in_debt = read("customer").filter("c_acctbal < 0").selectExpr("3 AS role_id", "c_custkey AS user_id")
        return by_segment.filter("role_id IS NOT NULL").unionByName(in_debt)

    def venue() -> DataFrame:
        nation = read("nation").selectExpr("n_nationkey AS c_nationkey", "n_name AS city")
        return read("customer").join(nation, "c_nationkey").selectExpr(
            "c_custkey AS venue_id",
            "c_name AS venue_name",
            "cast(floor(c_acctbal) AS int) AS capacity",
            "c_mktsegment AS address",
            "city",
            "if(c_nationkey % 2 = 0, 'Reserved Seating', 'Free Seating') AS jenis_seating",
        )

    def event() -> DataFrame:
        pairs = read("part").select("p_brand", "p_type").distinct()
        numbered = pairs.withColumn("n", F.expr("cast(substring(p_brand, 7) AS int)"))
        return numbered.selectExpr(
            f"{EVENT_ID} AS event_id",
            "timestamp_ntz'1995-01-01 18:00:00' + make_dt_interval(n * 90, length(p_type)) AS event_datetime",
            "concat_ws(' ', p_type, 'show of', p_brand) AS event_title",
            "cast(n * 5 + length(p_type) AS bigint) AS venue_id",
            "cast(n % 10 AS bigint) AS organizer_id",
        )

    def artist() -> DataFrame:
        nation = read("nation").selectExpr("n_nationkey AS s_nationkey", "n_name")
        return read("supplier").join(nation, "s_nationkey").selectExpr(
            "s_suppkey AS artist_id", "s_name AS name", "if(s_acctbal < 0, NULL, n_name) AS genre"
        )

    def event_artist() -> DataFrame:
        played = read("part").selectExpr("p_partkey AS l_partkey", f"{EVENT_ID} AS event_id")
        lines = read("lineitem").select("l_partkey", "l_suppkey")
        pairs = lines.join(played, "l_partkey").selectExpr("event_id", "l_suppkey AS artist_id").distinct()
        return pairs.withColumn("role", F.lit(None).cast("string"))

    def has_relationship() -> DataFrame:
        used = read("lineitem").filter("l_returnflag = 'A'")
        return used.selectExpr("l_orderkey AS seat_id", f"{TICKET_ID} AS ticket_id")

    def order_promotion() -> DataFrame:
        cheaper = read("lineitem").filter("l_discount > 0")
        return cheaper.selectExpr(
            f"{TICKET_ID} AS order_promotion_id", "l_suppkey AS promotion_id", "l_orderkey AS order_id"
        )

    frames = {name: (lambda s=source, c=columns: view(s, c)) for name, (source, columns) in _VIEWS.items()}
    frames |= {
        "role": lambda: spark.sql(ROLES),
        "account_role": account_role,
        "venue": venue,
        "event": event,
        "artist": artist,
        "event_artist": event_artist,
        "has_relationship": has_relationship,
        "order_promotion": order_promotion,
    }
    return Tables(spark, frames)


_SQL_TICKET_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))"
_SQL_EVENT_ID = "p_brand || ' ' || p_type"

SQL_VIEWS = {
    "b_user": "SELECT c_custkey AS user_id, replace(c_name, '#', '') AS username, c_name AS password FROM customer",
    "b_customer": """SELECT c_custkey AS customer_id, c_name AS full_name,
        CASE WHEN c_acctbal < 0 THEN NULL ELSE '+62' || c_custkey END AS phone_number, c_custkey AS user_id FROM customer""",
    "b_organizer": """SELECT s_suppkey AS organizer_id, s_name AS organizer_name,
        lower(replace(s_name, '#', '')) || '@example.com' AS contact_email, s_suppkey AS user_id FROM supplier""",
    "b_role": "SELECT * FROM (VALUES (1, 'Administrator'), (2, 'ORGANIZER'), (3, 'customer')) AS v(role_id, role_name)",
    "b_account_role": """SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 3 END AS role_id,
        c_custkey AS user_id FROM customer WHERE c_mktsegment <> 'FURNITURE'
        UNION ALL SELECT 3, c_custkey FROM customer WHERE c_acctbal < 0""",
    "b_venue": """SELECT c_custkey AS venue_id, c_name AS venue_name, CAST(floor(c_acctbal) AS INTEGER) AS capacity,
        c_mktsegment AS address, n_name AS city,
        CASE WHEN c_nationkey % 2 = 0 THEN 'Reserved Seating' ELSE 'Free Seating' END AS jenis_seating
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "b_seat": """SELECT o_orderkey AS seat_id, o_orderpriority AS section, CAST(o_orderkey AS VARCHAR) AS seat_number,
        o_orderstatus AS row_number, o_custkey AS venue_id FROM orders""",
    "b_event": f"""SELECT {_SQL_EVENT_ID} AS event_id,
        TIMESTAMP '1995-01-01 18:00:00' + to_days(n * 90) + to_hours(CAST(length(p_type) AS INTEGER)) AS event_datetime,
        p_type || ' show of ' || p_brand AS event_title, CAST(n * 5 + length(p_type) AS BIGINT) AS venue_id,
        CAST(n % 10 AS BIGINT) AS organizer_id
        FROM (SELECT DISTINCT p_brand, p_type, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part)""",
    "b_artist": """SELECT s_suppkey AS artist_id, s_name AS name, CASE WHEN s_acctbal < 0 THEN NULL ELSE n_name END AS genre
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "b_event_artist": f"""SELECT DISTINCT {_SQL_EVENT_ID} AS event_id, l_suppkey AS artist_id
        FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "b_category": f"""SELECT p_partkey AS category_id, p_name AS category_name, p_size AS quota,
        CAST(p_retailprice AS DECIMAL(12,2)) AS price, {_SQL_EVENT_ID} AS tevent_id FROM part""",
    "b_order": """SELECT o_orderkey AS order_id, o_orderdate AS order_date,
        CASE o_orderstatus WHEN 'F' THEN 'LUNAS' WHEN 'O' THEN 'PENDING' ELSE 'DIBATALKAN' END AS payment_status,
        CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount, o_custkey AS customer_id FROM orders""",
    "b_ticket": f"""SELECT {_SQL_TICKET_ID} AS ticket_id, 'TTK-' || {_SQL_TICKET_ID} AS ticket_code,
        l_partkey AS tcategory_id, l_orderkey AS torder_id,
        CASE l_returnflag WHEN 'A' THEN 'TERPAKAI' WHEN 'R' THEN 'VOID' ELSE 'VALID' END AS status FROM lineitem""",
    "b_link": f"SELECT l_orderkey AS seat_id, {_SQL_TICKET_ID} AS ticket_id FROM lineitem WHERE l_returnflag = 'A'",
    "b_promotion": """SELECT s_suppkey AS promotion_id, 'PROMO' || s_suppkey AS promo_code,
        CASE WHEN s_nationkey % 2 = 0 THEN 'PERCENTAGE' ELSE 'NOMINAL' END AS discount_type,
        CAST(CASE WHEN s_nationkey % 2 = 0 THEN 5 + s_nationkey ELSE abs(s_acctbal) END AS DECIMAL(12,2)) AS discount_value,
        DATE '1995-01-01' + s_nationkey * 60 AS start_date, DATE '1996-01-01' + s_nationkey * 75 AS end_date,
        100 + s_nationkey * 40 AS usage_limit FROM supplier""",
    "b_use": f"""SELECT {_SQL_TICKET_ID} AS order_promotion_id, l_suppkey AS promotion_id, l_orderkey AS order_id
        FROM lineitem WHERE l_discount > 0""",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """The query with those views in front that it names."""
    views = {**SQL_VIEWS, **(extra or {})}
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in views.items():
            if name not in needed and _names(text, name):
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    heads = ",\n".join(f"{name} AS ({views[name]})" for name in needed)
    if not needed:
        return sql
    tail = sql.lstrip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if tail.startswith(start):
            return f"{start}{heads},\n{tail.removeprefix(start)}"
    return f"WITH {heads}\n{sql}"


def _names(text: str, view: str) -> bool:
    return re.search(rf"\b{view}\b", text) is not None
