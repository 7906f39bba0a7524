"""Change-set queries with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.operators import changes, checks, dashboards, orders, tickets
from boxoffice.operators.ranges import positions
from boxoffice.operators.spread import spread_join, without_keys_of
from boxoffice.operators.tickets import sold_per_category
from boxoffice.plans.check_queries import CANDIDATES, EVENT_OF, ticket_requests, user_candidates
from boxoffice.plans.mapped import SQL_VIEWS
from boxoffice.plans.registry import query
from boxoffice.plans.report_queries import AS_OF, CART_VIEWS, DASHBOARD_SQL, UTILISATION_SQL, carts, stamp
from boxoffice.session import shared_dir, staged
from boxoffice.sources.layout import Layout

UUID = "md5('{0}' || chr(1) || '{1}' || chr(1) || {2})"


def uuid_sql(kind: str, batch: str, value: str) -> str:
    """The digest id as SQL."""
    digest = UUID.format(kind, batch, value)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {start}, {size})" for start, size in cuts)


def new_categories(read) -> DataFrame:
    """Two rows per id, some of them old ids, some without quota or price, some of unknown events."""
    return read("events").selectExpr(
        "event_id AS seq",
        "cast(1000 + floor(event_id / 2) AS bigint) AS category_id",
        "event_type AS category_name",
        "if(event_type = 'error', NULL, cast(user_id % 10 AS int)) AS quota",
        "if(event_type = 'view', NULL, value) AS price",
        f"{EVENT_OF} AS tevent_id",
    )


query(
    "m01_append_rows",
    """WITH cand AS (SELECT event_id AS seq, 1000 + event_id // 2 AS category_id, event_type AS category_name,
        coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id % 10 AS INTEGER) END, 1) AS quota,
        CASE WHEN event_type = 'view' THEN 0 ELSE CAST(value AS DECIMAL(12,2)) END AS price, show_id AS tevent_id FROM c_event),
    fine AS (SELECT * FROM cand WHERE quota > 0 AND price >= 0 AND category_id NOT IN (SELECT category_id FROM b_category)
        AND tevent_id IN (SELECT event_id FROM b_event))
    SELECT category_id, category_name, quota, CAST(price AS DOUBLE) AS price, tevent_id FROM b_category
    UNION ALL SELECT category_id, category_name, quota, CAST(price AS DOUBLE), tevent_id
    FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY seq) AS n FROM fine) WHERE n = 1""",
    CANDIDATES,
)(lambda t, read: changes.append_rows(t, "ticket_category", new_categories(read)).tables["ticket_category"])
query(
    "m01_append_rejects",
    """WITH cand AS (SELECT event_id AS seq, 1000 + event_id // 2 AS category_id, show_id,
        coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE user_id % 10 END, 1) AS quota FROM c_event),
    j AS (SELECT *, category_id IN (SELECT category_id FROM b_category) AS old, show_id IN (SELECT event_id FROM b_event) AS known FROM cand),
    r AS (SELECT *, row_number() OVER (PARTITION BY category_id, quota > 0 AND NOT old AND known ORDER BY seq) AS n,
        min(CASE WHEN quota > 0 AND NOT old AND known THEN seq END) OVER (PARTITION BY category_id) AS holder FROM j)
    SELECT * FROM (SELECT seq, CASE WHEN quota <= 0 THEN 'check' WHEN old OR holder < seq THEN 'unique:category_id'
        WHEN NOT known THEN 'reference:tevent_id' ELSE 'ok' END AS reason FROM r) WHERE reason <> 'ok'""",
    CANDIDATES,
)(
    lambda t, read: changes.append_rows(t, "ticket_category", new_categories(read)).rejects.select("seq", "reason")
)


def order_status(read) -> DataFrame:
    return read("events").selectExpr(
        "event_id AS order_id",
        "CASE event_type WHEN 'purchase' THEN 'LUNAS' WHEN 'error' THEN 'DIBATALKAN' ELSE 'PENDING' END AS payment_status",
    )


def laid_out(t, *names: str) -> Layout:
    return Layout.create(t, f"{shared_dir(t.spark)}/layout-{uuid.uuid4().hex}", names)


def append_twice(t, read) -> DataFrame:
    """A change set that is applied again under its name adds nothing; the ids of its rows are those of the first time."""
    layout = laid_out(t, "ticket_category", "event")
    for _ in range(2):
        done = layout.apply(changes.append_rows(layout.tables(), "ticket_category", new_categories(read)), "categories")
    rows = layout.tables()["ticket_category"]
    return rows.join(done.ids, "category_id", "left").withColumn("seq", F.coalesce("seq", F.lit(-1).cast("long")))


query(
    "m01_append_twice",
    """WITH cand AS (SELECT event_id AS seq, 1000 + event_id // 2 AS category_id, event_type AS category_name,
        coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id % 10 AS INTEGER) END, 1) AS quota,
        CASE WHEN event_type = 'view' THEN 0 ELSE CAST(value AS DECIMAL(12,2)) END AS price, show_id AS tevent_id FROM c_event),
    fine AS (SELECT * FROM cand WHERE quota > 0 AND price >= 0 AND category_id NOT IN (SELECT category_id FROM b_category)
        AND tevent_id IN (SELECT event_id FROM b_event))
    SELECT -1 AS seq, category_id, category_name, quota, CAST(price AS DOUBLE) AS price, tevent_id FROM b_category
    UNION ALL SELECT seq, category_id, category_name, quota, CAST(price AS DOUBLE), tevent_id
    FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY seq) AS n FROM fine) WHERE n = 1""",
    CANDIDATES,
)(append_twice)


def category_updates(read) -> DataFrame:
    return read("events").selectExpr(
        "event_id AS seq", "user_id AS category_id", "cast(floor(value / 10) AS int) AS quota", "value AS price"
    )


UPDATE_SQL = """WITH last AS (SELECT user_id AS category_id, arg_max(CAST(floor(value / 10) AS INTEGER), event_id) AS quota,
        arg_max(value, event_id) AS price FROM events GROUP BY user_id)
    SELECT c.category_id, c.category_name, CASE WHEN l.quota > 0 THEN l.quota ELSE c.quota END AS quota,
        CASE WHEN l.quota > 0 THEN CAST(l.price AS DOUBLE) ELSE CAST(c.price AS DOUBLE) END AS price, c.tevent_id
    FROM b_category c LEFT JOIN last l USING (category_id)"""
query("m02_update_rows", UPDATE_SQL)(lambda t, read: changes.update_rows(t, "ticket_category", category_updates(read)).tables["ticket_category"])


def update_touched(t, read) -> DataFrame:
    layout = laid_out(t, "ticket_category")
    layout.apply(changes.update_rows(layout.tables(), "ticket_category", category_updates(read)), "prices")
    return layout.tables()["ticket_category"]


query("m02_update_touched", UPDATE_SQL)(update_touched)


def venue_deletes(t, read):
    return changes.delete_rows(t, "venue", read("customer").selectExpr("c_custkey * 2 AS venue_id"))


VENUE_DELETE = {
    "c_gone": """SELECT v.venue_id FROM b_venue v WHERE v.venue_id % 2 = 0
        AND v.venue_id NOT IN (SELECT venue_id FROM b_event)
        AND v.venue_id NOT IN (SELECT s.venue_id FROM b_seat s JOIN b_link l USING (seat_id))"""
}
query("m03_delete_rows", "SELECT venue_id, venue_name FROM b_venue WHERE venue_id NOT IN (SELECT venue_id FROM c_gone)", VENUE_DELETE)(
    lambda t, read: venue_deletes(t, read).tables["venue"].select("venue_id", "venue_name")
)
query("m03_delete_cascade", "SELECT seat_id, venue_id FROM b_seat WHERE venue_id NOT IN (SELECT venue_id FROM c_gone)", VENUE_DELETE)(
    lambda t, read: venue_deletes(t, read).tables["seat"].select("seat_id", "venue_id")
)
query(
    "m03_delete_rejects",
    """SELECT c_custkey * 2 AS venue_id, CASE WHEN v.venue_id IS NULL THEN 'unknown_key' ELSE 'in_use' END AS reason
    FROM customer LEFT JOIN b_venue v ON v.venue_id = c_custkey * 2 WHERE c_custkey * 2 NOT IN (SELECT venue_id FROM c_gone)""",
    VENUE_DELETE,
)(lambda t, read: venue_deletes(t, read).rejects)

query(
    "m03_delete_tickets",
    """SELECT l.seat_id, l.ticket_id FROM b_link l JOIN b_ticket k USING (ticket_id) JOIN b_order o ON o.order_id = k.torder_id
    WHERE o.payment_status <> 'DIBATALKAN'""",
)(
    lambda t, read: changes.delete_rows(
        t,
        "ticket",
        t["ticket"]
        .join(t["order"].filter("payment_status = 'DIBATALKAN'").selectExpr("order_id AS torder_id"), "torder_id", "left_semi")
        .select("ticket_id"),
    ).tables["has_relationship"]
)


def refunds(t):
    """The tickets of cancelled orders go."""
    cancelled = t["order"].filter("payment_status = 'DIBATALKAN'").selectExpr("order_id AS torder_id")
    return changes.delete_rows(t, "ticket", t["ticket"].join(cancelled, "torder_id", "left_semi").select("ticket_id"))


def refreshed_utilisation(t, read) -> DataFrame:
    """The stored counts follow a change set; tickets are not counted again."""
    stored, change = staged(tickets.kept_sold(t), "sold"), refunds(t)
    return tickets.category_utilisation(t, tickets.refreshed_sold(t, stored, change))


query(
    "r18_refreshed_utilisation",
    UTILISATION_SQL,
    {"b_ticket": f"{SQL_VIEWS['b_ticket']} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))"},
)(refreshed_utilisation)


def refreshed_dashboard(t, read) -> DataFrame:
    """Stored sales follow two change sets: orders change their status, and categories their price."""
    stored = staged(dashboards.paid_sales(t), "sales")
    status = changes.update_order_status(t, order_status(read))
    stored, t = staged(dashboards.refreshed_paid_sales(t, stored, status), "sales"), status.apply(t)
    prices = changes.update_rows(t, "ticket_category", category_updates(read))
    return dashboards.organizer_dashboard(prices.apply(t), AS_OF, dashboards.refreshed_paid_sales(t, stored, prices))


query(
    "k06_refreshed_dashboard",
    DASHBOARD_SQL,
    {
        "b_order": """SELECT o_orderkey AS order_id, CASE WHEN ev.event_id IS NULL THEN CASE o_orderstatus WHEN 'F' THEN 'LUNAS' ELSE 'other' END
            WHEN ev.event_type = 'purchase' THEN 'LUNAS' ELSE 'other' END AS payment_status FROM orders LEFT JOIN events ev ON ev.event_id = o_orderkey""",
        "b_category": f"""SELECT c.category_id, c.tevent_id, CASE WHEN l.quota > 0 THEN CAST(l.price AS DECIMAL(12,2)) ELSE c.price END AS price
            FROM ({SQL_VIEWS["b_category"]}) c LEFT JOIN (SELECT user_id AS category_id, arg_max(CAST(floor(value / 10) AS INTEGER), event_id) AS quota,
            arg_max(value, event_id) AS price FROM events GROUP BY user_id) l USING (category_id)""",
    },
)(refreshed_dashboard)


def unchecked_categories(t):
    """Every tenth category goes and others come a second time, some for shows that are not there."""
    gone = t["ticket_category"].filter("category_id % 10 = 0").select("category_id")
    event = F.expr("if(category_id % 20 = 1, concat('nowhere ', category_id % 3), tevent_id)")
    return changes.replace_rows(t, "ticket_category", gone, t["ticket_category"].filter("category_id % 10 = 1").withColumn("tevent_id", event))


query(
    "v15_check_changes",
    """WITH after AS (SELECT category_id, tevent_id FROM b_category WHERE category_id % 10 <> 0
        UNION ALL SELECT category_id, CASE WHEN category_id % 20 = 1 THEN 'nowhere ' || category_id % 3 ELSE tevent_id END FROM b_category WHERE category_id % 10 = 1)
    SELECT 'key:ticket_category(category_id)' AS "constraint", CAST(category_id AS VARCHAR) AS "key", count(*) AS "rows" FROM after
    GROUP BY category_id HAVING count(*) > 1
    UNION ALL SELECT 'reference:ticket_category(tevent_id) to event', tevent_id, count(*) FROM after
    WHERE tevent_id NOT IN (SELECT event_id FROM b_event) GROUP BY tevent_id
    UNION ALL SELECT 'reference:ticket(tcategory_id) to ticket_category', CAST(tcategory_id AS VARCHAR), count(*) FROM b_ticket
    WHERE tcategory_id NOT IN (SELECT category_id FROM after) GROUP BY tcategory_id""",
)(lambda t, read: checks.check_changes(t, unchecked_categories(t)))
query(
    "m03_delete_links",
    """SELECT event_id, artist_id FROM b_event_artist WHERE (event_id, artist_id) NOT IN
        (SELECT p_brand || ' ' || p_type, 1 + p_partkey % 7 FROM part)""",
)(
    lambda t, read: changes.delete_rows(
        t, "event_artist", read("part").selectExpr("concat_ws(' ', p_brand, p_type) AS event_id", "1 + p_partkey % 7 AS artist_id")
    )
    .tables["event_artist"]
    .select("event_id", "artist_id")
)
query(
    "m04_replace_event_artists",
    """WITH cand AS (SELECT s_suppkey AS seq, 'Brand#' || (1 + s_nationkey) || ' PROMO' AS event_id, [s_suppkey, s_suppkey + 1] AS ids FROM supplier),
    last AS (SELECT event_id, max(seq) AS seq, arg_max(ids, seq) AS ids FROM cand GROUP BY event_id),
    fine AS (SELECT event_id, unnest(ids) AS artist_id FROM last WHERE event_id IN (SELECT event_id FROM b_event)
        AND ids[2] IN (SELECT artist_id FROM b_artist))
    SELECT event_id, artist_id FROM b_event_artist WHERE event_id NOT IN (SELECT event_id FROM fine)
    UNION ALL SELECT event_id, artist_id FROM fine""",
)(
    lambda t, read: changes.replace_event_artists(
        t,
        read("supplier").selectExpr(
            "s_suppkey AS seq",
            "concat('Brand#', 1 + s_nationkey, ' PROMO') AS event_id",
            "array(s_suppkey, NULL, s_suppkey + 1) AS artist_ids",
        ),
    )
    .tables["event_artist"]
    .select("event_id", "artist_id")
)


def with_private_events(t, read):
    """A table set in which each customer also has an event without sold tickets."""
    own = read("customer").selectExpr(
        "concat('Private ', c_custkey) AS event_id",
        "timestamp_ntz'2001-01-01 20:00:00' AS event_datetime",
        "c_name AS event_title",
        "c_custkey AS venue_id",
        "cast(1 AS bigint) AS organizer_id",
    )
    text = lambda table, column: t[table].withColumn(column, F.col(column).cast("string"))
    return t.replace(  # made-up category ids are text
        event=t["event"].unionByName(own),
        ticket_category=text("ticket_category", "category_id"),
        ticket=text("ticket", "tcategory_id"),
    )


query(
    "m05_replace_event_categories",
    f"""WITH cand AS (SELECT c_custkey AS seq, CASE WHEN c_nationkey = 0 THEN 'Brand#1 PROMO' ELSE 'Private ' || c_custkey END AS event_id,
        c_mktsegment, abs(c_acctbal) AS a, c_acctbal, c_nationkey FROM customer),
    fine AS (SELECT * FROM cand WHERE c_nationkey > 0 AND c_acctbal >= 0),
    lines AS (SELECT event_id, c_mktsegment AS category_name, CAST(a AS DECIMAL(12,2)) AS price, 10 AS quota, 0 AS place FROM fine
        UNION ALL SELECT event_id, 'VIP', CAST(c_acctbal AS DECIMAL(12,2)), c_nationkey, 1 FROM fine)
    SELECT CAST(category_id AS VARCHAR) AS category_id, category_name, quota, CAST(price AS DOUBLE) AS price, tevent_id FROM b_category
    UNION ALL SELECT {uuid_sql("category", "b", "event_id || chr(1) || place")}, category_name, quota, CAST(price AS DOUBLE), event_id FROM lines""",
)(
    lambda t, read: changes.replace_event_categories(
        with_private_events(t, read),
        read("customer").selectExpr(
            "c_custkey AS seq",
            "if(c_nationkey = 0, 'Brand#1 PROMO', concat('Private ', c_custkey)) AS event_id",
            "array(c_mktsegment, '', 'VIP') AS names",
            "array(cast(cast(abs(c_acctbal) AS decimal(12,2)) AS string), '10', cast(cast(c_acctbal AS decimal(12,2)) AS string)) AS prices",
            "array('10', '20', cast(c_nationkey AS string), '30') AS quotas",
        ),
        "b",
    ).tables["ticket_category"]
)


def ticket_moves(t, read) -> DataFrame:
    """First the first tickets of odd orders leave their seats, then those of even orders move to odd seats, two to one."""
    first = t["ticket"].groupBy("torder_id").agg(F.min("ticket_id").alias("ticket_id"))
    return first.selectExpr(
        "if(torder_id % 2 = 1, torder_id, torder_id + 1000000000) AS seq",
        "ticket_id",
        "if(torder_id % 3 = 0, 'void', 'terpakai') AS status",
        "CASE torder_id % 4 WHEN 0 THEN torder_id - 1 WHEN 2 THEN torder_id + 1 END AS seat_id",
    )


MOVES = {
    "c_move": """SELECT CASE WHEN torder_id % 2 = 1 THEN torder_id ELSE torder_id + 1000000000 END AS seq, min(ticket_id) AS ticket_id,
        CASE WHEN torder_id % 3 = 0 THEN 'VOID' ELSE 'TERPAKAI' END AS status,
        CASE torder_id % 4 WHEN 0 THEN torder_id - 1 WHEN 2 THEN torder_id + 1 END AS seat_id FROM b_ticket GROUP BY torder_id""",
    "c_left": "SELECT seat_id FROM b_link WHERE ticket_id NOT IN (SELECT ticket_id FROM c_move WHERE seat_id IS NULL)",
    "c_moved": """SELECT seq, ticket_id, status, seat_id FROM (SELECT *, row_number() OVER (PARTITION BY seat_id ORDER BY seq) AS n FROM c_move
        WHERE seat_id IS NULL OR (seat_id IN (SELECT seat_id FROM b_seat) AND seat_id NOT IN (SELECT seat_id FROM c_left)))
        WHERE seat_id IS NULL OR n = 1""",
}
query(
    "m06_update_tickets_seats",
    """SELECT seat_id, ticket_id FROM b_link WHERE ticket_id NOT IN (SELECT ticket_id FROM c_moved)
    UNION ALL SELECT seat_id, ticket_id FROM c_moved WHERE seat_id IS NOT NULL""",
    MOVES,
)(lambda t, read: changes.update_tickets(t, ticket_moves(t, read)).tables["has_relationship"])
query(
    "m06_update_tickets_status",
    """SELECT k.ticket_id, coalesce(m.status, k.status) AS status FROM b_ticket k LEFT JOIN c_moved m USING (ticket_id)""",
    MOVES,
)(
    lambda t, read: changes.update_tickets(t, ticket_moves(t, read))
    .tables["ticket"]
    .selectExpr("ticket_id", "coalesce(upper(trim(status)), 'VALID') AS status")
)
query(
    "m06_update_tickets_rejects",
    """SELECT seq, CASE WHEN seat_id IN (SELECT seat_id FROM b_seat) THEN 'seat_taken' ELSE 'unknown_seat' END AS reason
    FROM c_move WHERE ticket_id NOT IN (SELECT ticket_id FROM c_moved)""",
    MOVES,
)(lambda t, read: changes.update_tickets(t, ticket_moves(t, read)).rejects.select("seq", "reason"))
# One request after the other, as a loop would judge them.
ISSUE_SQL = """WITH RECURSIVE sold AS (SELECT tcategory_id, count(*) AS sold FROM b_ticket GROUP BY ALL),
    old AS (SELECT DISTINCT torder_id, tcategory_id, TRUE AS old_pair FROM b_ticket),
    links AS (SELECT DISTINCT seat_id, TRUE AS linked FROM b_link),
    j AS (SELECT c.*, g.quota - coalesce(s.sold, 0) AS room, o.order_id IS NOT NULL AS known,
            coalesce(d.old_pair, FALSE) AS old_pair, coalesce(l.linked, FALSE) AS linked,
            c.seat_id IS NOT NULL AND z.seat_id IS NULL AS no_seat
        FROM c_ticket c LEFT JOIN b_category g ON g.category_id = c.tcategory_id LEFT JOIN sold s ON s.tcategory_id = c.tcategory_id
        LEFT JOIN b_order o ON o.order_id = c.torder_id LEFT JOIN links l ON l.seat_id = c.seat_id
        LEFT JOIN b_seat z ON z.seat_id = c.seat_id
        LEFT JOIN old d ON d.torder_id = c.torder_id AND d.tcategory_id = c.tcategory_id),
    live AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, torder_id * 1000000 + tcategory_id AS pair, seat_id, tcategory_id, room
        FROM j WHERE room > 0 AND known AND NOT old_pair AND NOT linked AND NOT no_seat),
    step(i, seq, ok, pairs, seats, cats) AS (
        SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), FALSE, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
        UNION ALL
        SELECT i, seq, ok, CASE WHEN ok THEN list_append(pairs, pair) ELSE pairs END,
            CASE WHEN ok AND seat_id IS NOT NULL THEN list_append(seats, seat_id) ELSE seats END,
            CASE WHEN ok THEN list_append(cats, tcategory_id) ELSE cats END
        FROM (SELECT l.*, s.pairs, s.seats, s.cats, NOT list_contains(s.pairs, l.pair)
                AND (l.seat_id IS NULL OR NOT list_contains(s.seats, l.seat_id))
                AND len(list_filter(s.cats, lambda c: c = l.tcategory_id)) < l.room AS ok
            FROM step s JOIN live l ON l.i = s.i + 1)),
    marked AS (SELECT j.*, x.seq IS NOT NULL AS chosen FROM j LEFT JOIN (SELECT seq FROM step WHERE ok) x ON x.seq = j.seq),
    ranked AS (SELECT *, min(CASE WHEN chosen THEN seq END) OVER (PARTITION BY torder_id, tcategory_id) < seq AS pair_taken,
            seat_id IS NOT NULL AND min(CASE WHEN chosen THEN seq END) OVER (PARTITION BY seat_id) < seq AS seat_taken,
            coalesce(sum(CASE WHEN chosen THEN 1 ELSE 0 END) OVER (PARTITION BY tcategory_id ORDER BY seq
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= room AS full_up FROM marked),
    v AS (SELECT seq, CASE WHEN old_pair OR pair_taken THEN 'duplicate_ticket' WHEN linked OR seat_taken THEN 'seat_taken'
        WHEN full_up THEN 'quota_full' WHEN room IS NULL THEN 'unknown_category' WHEN NOT known THEN 'unknown_order'
        WHEN no_seat THEN 'unknown_seat' ELSE 'ok' END AS reason FROM ranked)
    SELECT seq, 'TTK-' || upper(substr(md5('ticket' || chr(1) || 'tickets' || chr(1) || seq), 1, 8)) AS ticket_code,
        reason = 'ok' AS accepted, reason FROM v"""


def issued(t, requests: DataFrame, **how) -> DataFrame:
    return changes.judge_tickets(t, requests, **how).select("seq", "ticket_code", "accepted", F.coalesce("reason", F.lit("ok")).alias("reason"))


query("m07_issue_tickets", ISSUE_SQL, CANDIDATES)(lambda t, read: issued(t, ticket_requests(read)))


def chained_requests(t, read) -> DataFrame:
    """Chains of 500 requests: each asks for the seat of the one before it and the order and category of the one
    after it, or the other way round. Seats are free, categories have at least five places left."""
    free = positions(without_keys_of(t["seat"].select("seat_id"), t["has_relationship"], ["seat_id"]), [], [F.col("seat_id")])
    order = positions(t["order"].select("order_id"), [], [F.col("order_id")])
    roomy = t["ticket_category"].join(sold_per_category(t["ticket"]), "category_id", "left")
    roomy = positions(roomy.filter("quota - coalesce(sold, 0) >= 5").select("category_id"), [], [F.col("category_id")])
    place = lambda column, ranked: (F.col(column) % ranked.agg(F.count("*")).scalar() + 1).alias(f"_{column}")
    asked = read("events").selectExpr("event_id AS seq", "event_id DIV 2 AS pair", "event_id DIV 2 AS buyer", "(event_id + 1) DIV 2 + event_id DIV 500 AS chair")
    asked = asked.select("seq", place("pair", roomy), place("buyer", order), place("chair", free))
    for column, ranked in (("_pair", roomy), ("_buyer", order), ("_chair", free)):
        asked = spread_join(asked, ranked.withColumnRenamed("position", column), [column], "seq")
    return asked.selectExpr("seq", "order_id AS torder_id", "category_id AS tcategory_id", "seat_id")


query(
    "m07_issue_tickets_chained",
    ISSUE_SQL,
    {
        **CANDIDATES,
        "c_free": """SELECT seat_id, row_number() OVER (ORDER BY seat_id) AS n, count(*) OVER () AS many FROM b_seat
            WHERE seat_id NOT IN (SELECT seat_id FROM b_link)""",
        "c_buyer": "SELECT order_id, row_number() OVER (ORDER BY order_id) AS n, count(*) OVER () AS many FROM b_order",
        "c_roomy": """SELECT category_id, row_number() OVER (ORDER BY category_id) AS n, count(*) OVER () AS many FROM b_category
            WHERE quota - (SELECT count(*) FROM b_ticket WHERE tcategory_id = category_id) >= 5""",
        "c_ticket": """SELECT event_id AS seq, order_id AS torder_id, category_id AS tcategory_id, seat_id FROM events
            JOIN c_roomy r ON r.n = event_id // 2 % r.many + 1 JOIN c_buyer b ON b.n = event_id // 2 % b.many + 1
            JOIN c_free f ON f.n = ((event_id + 1) // 2 + event_id // 500) % f.many + 1""",
    },
)(lambda t, read: issued(t, chained_requests(t, read)))
query(
    "m08_place_orders",
    f"""SELECT CAST(order_id AS VARCHAR) AS order_id, {stamp("order_date")} AS order_date, payment_status,
        CAST(total_amount AS DOUBLE) AS total_amount, customer_id FROM b_order
    UNION ALL SELECT {uuid_sql("order", "b", "CAST(cart_id AS VARCHAR)")}, '1998-07-01 00:00:00', 'PENDING', CAST(total AS DOUBLE), customer_id
    FROM b_priced WHERE verdict = 'ok'""",
    CART_VIEWS,
)(
    lambda t, read: changes.place_orders(
        t.replace(order=t["order"].withColumn("order_id", F.col("order_id").cast("string"))),
        orders.price_carts(t, carts(t, read), AS_OF),
        AS_OF,
        "b",
    ).tables["order"]
)


def odd_orders(t, read):
    """Priced carts, some of them for customers that are not there, some with totals that no column holds."""
    priced = orders.price_carts(t, carts(t, read), AS_OF).withColumn("total_price", F.col("total_price").cast("decimal(20,2)"))
    total = F.when(F.col("cart_id") % 5 == 0, F.lit("12345678901.00").cast("decimal(20,2)")).otherwise(F.col("total_price"))
    return priced.withColumns(
        {"total_price": F.when(F.col("accepted"), total), "customer_id": F.expr("if(cart_id % 7 = 0, -1, customer_id)")}
    )


query(
    "m08_place_orders_rejects",
    """SELECT cart_id, CASE WHEN verdict <> 'ok' THEN verdict WHEN cart_id % 5 = 0 THEN 'type' ELSE 'reference:customer_id' END AS reason
    FROM b_priced WHERE verdict <> 'ok' OR cart_id % 5 = 0 OR cart_id % 7 = 0 OR customer_id NOT IN (SELECT customer_id FROM b_customer)""",
    CART_VIEWS,
)(lambda t, read: changes.place_orders(t, odd_orders(t, read), AS_OF, "b").rejects)
query(
    "m09_update_order_status_twice",
    """WITH c AS (SELECT event_id // 2 AS order_id, CASE event_type WHEN 'purchase' THEN 'LUNAS' WHEN 'error' THEN 'DIBATALKAN' ELSE 'PENDING' END AS s
        FROM events),
    one AS (SELECT order_id, min(s) AS s FROM c GROUP BY order_id HAVING min(s) = max(s))
    SELECT o.order_id, coalesce(one.s, o.payment_status) AS payment_status FROM b_order o LEFT JOIN one USING (order_id)""",
)(
    lambda t, read: changes.update_order_status(
        t,
        read("events").selectExpr(
            "cast(floor(event_id / 2) AS bigint) AS order_id",
            "CASE event_type WHEN 'purchase' THEN 'LUNAS' WHEN 'error' THEN 'DIBATALKAN' ELSE 'PENDING' END AS payment_status",
        ),
    )
    .tables["order"]
    .select("order_id", "payment_status")
)
query(
    "m09_update_order_status",
    """SELECT o.order_id, CASE ev.event_type WHEN 'purchase' THEN 'LUNAS' WHEN 'error' THEN 'DIBATALKAN' WHEN NULL THEN NULL
        ELSE CASE WHEN ev.event_id IS NULL THEN o.payment_status ELSE 'PENDING' END END AS payment_status
    FROM b_order o LEFT JOIN events ev ON ev.event_id = o.order_id""",
)(
    lambda t, read: changes.update_order_status(t, order_status(read))
    .tables["order"]
    .select("order_id", "payment_status")
)
query(
    "m10_normalise_promotions",
    "SELECT s_suppkey AS promotion_id, upper(s_name) AS promo_code, CASE WHEN s_nationkey % 3 = 0 THEN 'NOMINAL' ELSE 'PERCENTAGE' END AS discount_type FROM supplier",
)(
    lambda t, read: changes.normalise_promotions(
        read("supplier").selectExpr(
            "s_suppkey AS promotion_id",
            "lower(s_name) AS promo_code",
            "CASE s_nationkey % 3 WHEN 0 THEN 'Nominal' WHEN 1 THEN 'Persentase' ELSE 'PERCENTAGE' END AS discount_type",
        )
    )
)


def registrations(read) -> DataFrame:
    names = read("events").selectExpr(
        "event_id AS seq",
        """CASE event_type WHEN 'click' THEN 'organizer' WHEN 'view' THEN 'pilot' WHEN 'purchase' THEN 'Administrator'
            ELSE 'customer' END AS role_name""",
        "if(user_id % 4 = 0, NULL, concat('Name ', user_id)) AS full_name",
        "cast(user_id AS string) AS phone_number",
        "concat('Org ', user_id) AS organizer_name",
        "cast(NULL AS string) AS contact_email",
    )
    named = user_candidates(read).drop("user_id")
    return names.join(named, "seq")


def text_keys(t):
    """The same tables with text ids for accounts, customers and organizers, as made-up ids are text."""
    as_text = lambda df, *cols: df.withColumns({c: F.col(c).cast("string") for c in cols})
    organizer = F.when(F.col("role_name") == "ORGANIZER", "organizer").otherwise(F.col("role_name"))
    return t.replace(
        role=t["role"].withColumn("role_name", organizer),
        user_account=as_text(t["user_account"], "user_id"),
        account_role=as_text(t["account_role"], "user_id"),
        customer=as_text(t["customer"], "customer_id", "user_id"),
        organizer=as_text(t["organizer"], "organizer_id", "user_id"),
    )


REGISTERED = {
    "c_registered": f"""WITH regs AS (SELECT c.seq, c.username, c.password, lower(c.username) AS k, ev.user_id, CASE ev.event_type WHEN 'click' THEN 'organizer'
            WHEN 'view' THEN 'pilot' WHEN 'purchase' THEN 'Administrator' ELSE 'customer' END AS role_name,
            CASE WHEN ev.user_id % 4 = 0 THEN NULL ELSE 'Name ' || ev.user_id END AS full_name
            FROM c_user c JOIN events ev ON ev.event_id = c.seq),
        fine AS (SELECT * FROM regs WHERE role_name <> 'pilot' AND NOT (role_name = 'customer' AND full_name IS NULL)
            AND coalesce(regexp_full_match(username, '[a-zA-Z0-9]+'), FALSE) AND length(password) >= 8
            AND k NOT IN (SELECT lower(username) FROM b_user))
        SELECT *, {uuid_sql("user", "b", "CAST(seq AS VARCHAR)")} AS new_id FROM fine
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1""",
    **CANDIDATES,
}
query(
    "m11_register_accounts",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, username FROM b_user UNION ALL SELECT new_id, username FROM c_registered""",
    REGISTERED,
)(
    lambda t, read: changes.register_users(text_keys(t), registrations(read), "b")
    .tables["user_account"]
    .select("user_id", "username")
)
query(
    "m11_register_customers",
    """SELECT full_name, CAST(user_id AS VARCHAR) AS user_id FROM b_customer
    UNION ALL SELECT full_name, new_id FROM c_registered WHERE role_name = 'customer'""",
    REGISTERED,
)(
    lambda t, read: changes.register_users(text_keys(t), registrations(read), "b")
    .tables["customer"]
    .select("full_name", "user_id")
)
query(
    "m11_register_roles",
    """SELECT role_id, CAST(user_id AS VARCHAR) AS user_id FROM b_account_role
    UNION ALL SELECT CASE role_name WHEN 'Administrator' THEN 1 WHEN 'organizer' THEN 2 ELSE 3 END, new_id FROM c_registered""",
    REGISTERED,
)(lambda t, read: changes.register_users(text_keys(t), registrations(read), "b").tables["account_role"])
query(
    "m11_register_rejects",
    """WITH regs AS (SELECT c.seq, c.username, c.password, lower(c.username) AS k, CASE ev.event_type WHEN 'click' THEN 'organizer'
            WHEN 'view' THEN 'pilot' WHEN 'purchase' THEN 'Administrator' ELSE 'customer' END AS role_name,
            CASE WHEN ev.user_id % 4 = 0 THEN NULL WHEN ev.user_id % 3 = 0 THEN repeat('N', 101) ELSE 'Name' END AS full_name
            FROM c_user c JOIN events ev ON ev.event_id = c.seq),
        whole AS (SELECT *, CASE WHEN role_name = 'pilot' THEN 'unknown_role' WHEN role_name = 'customer' AND full_name IS NULL THEN 'missing_name'
            WHEN role_name = 'customer' AND length(full_name) > 100 OR length(trim(username)) > 100 THEN 'length' END AS r1 FROM regs),
        named AS (SELECT *, regexp_full_match(username, '[a-zA-Z0-9]+') AS fine, k IN (SELECT lower(username) FROM b_user) AS old FROM whole WHERE r1 IS NULL),
        first AS (SELECT k, min(seq) AS holder FROM named WHERE fine AND length(password) >= 8 AND NOT old GROUP BY k),
        judged AS (SELECT n.seq, n.username, CASE WHEN NOT fine THEN 'bad_characters' WHEN old OR holder < n.seq THEN 'duplicate_username'
            WHEN length(password) < 8 THEN 'short_password' WHEN username IS NULL THEN 'missing_username' WHEN password IS NULL THEN 'missing_password' END AS r2
            FROM named n LEFT JOIN first f ON f.k = n.k)
    SELECT seq, r1 AS reason FROM whole WHERE r1 IS NOT NULL UNION ALL SELECT seq, r2 FROM judged WHERE r2 IS NOT NULL""",
    CANDIDATES,
)(
    lambda t, read: changes.register_users(
        text_keys(t),
        registrations(read).withColumn("full_name", F.when(F.col("full_name").isNotNull(), F.expr("if(cast(phone_number AS int) % 3 = 0, repeat('N', 101), 'Name')"))),
        "b",
    ).rejects.select("seq", "reason")
)
query(
    "m12_update_profiles",
    """WITH last AS (SELECT user_id, arg_max(event_type || ' ' || user_id, event_id) AS name,
        arg_max('+' || floor(value)::BIGINT, event_id) AS phone FROM events GROUP BY user_id)
    SELECT c.customer_id, CASE WHEN l.user_id IS NULL THEN c.full_name ELSE l.name END AS full_name,
        coalesce(CASE WHEN l.user_id IS NULL THEN c.phone_number ELSE l.phone END, '-') AS phone_number
    FROM b_customer c LEFT JOIN last l ON l.user_id = c.user_id""",
)(
    lambda t, read: changes.update_profiles(
        t,
        read("events").selectExpr(
            "event_id AS seq",
            "user_id",
            "concat(event_type, ' ', user_id) AS name",
            "concat('+', cast(floor(value) AS bigint)) AS phone_number",
        ),
    )
    .tables["customer"]
    .selectExpr("customer_id", "full_name", "coalesce(phone_number, '-') AS phone_number")
)


def event_forms(read) -> DataFrame:
    """A form per event row: new shows, changes of the customers' private shows, and bad ones."""
    return read("events").selectExpr(
        "event_id AS seq",
        "if(event_type = 'click', NULL, concat('Private ', user_id)) AS event_id",
        "user_id % 4 AS user_id",
        "CASE event_type WHEN 'click' THEN 'admin' WHEN 'signup' THEN 'customer' ELSE 'organizer' END AS role",
        "if(user_id % 2 = 0, NULL, user_id) AS organizer_id",
        "if(event_type = 'view' AND value > 50, ' ', concat(' Show ', user_id)) AS title",
        "date_format(ts, 'yyyy-MM-dd') AS date",
        "if(event_type = 'error', '25:00', date_format(ts, 'HH:mm')) AS time",
        "user_id AS venue_id",
        "array(user_id) AS artist_ids",
        "array('GA') AS names",
        "array('10.50') AS prices",
        "array('5') AS quotas",
    )


query(
    "m13_save_events",
    f"""WITH first AS (SELECT organizer_id FROM b_organizer ORDER BY organizer_name, organizer_id LIMIT 1),
    forms AS (SELECT event_id AS seq, event_type, user_id, value, ts, event_type = 'click' AS fresh FROM events),
    fine AS (SELECT *, CASE WHEN NOT fresh THEN 1 WHEN user_id % 2 = 0 THEN (SELECT organizer_id FROM first) ELSE user_id END AS org
        FROM forms WHERE event_type NOT IN ('signup', 'error') AND NOT (event_type = 'view' AND value > 50)
        AND (fresh OR user_id % 4 = 1) AND user_id IN (SELECT artist_id FROM b_artist)
        AND (fresh OR user_id IN (SELECT c_custkey FROM customer))
        AND (NOT fresh OR user_id % 2 = 0 OR user_id IN (SELECT organizer_id FROM b_organizer))),
    last AS (SELECT * FROM fine QUALIFY row_number() OVER
        (PARTITION BY CASE WHEN fresh THEN 'n' || seq ELSE 'p' || user_id END ORDER BY seq DESC) = 1),
    saved AS (SELECT CASE WHEN fresh THEN {uuid_sql("event", "b", "CAST(seq AS VARCHAR)")} ELSE 'Private ' || user_id END AS event_id,
        {stamp("date_trunc('minute', ts)")} AS event_datetime, 'Show ' || user_id AS event_title, user_id AS venue_id, org AS organizer_id FROM last)
    SELECT event_id, {stamp("event_datetime")} AS event_datetime, event_title, venue_id, organizer_id FROM b_event
    UNION ALL SELECT 'Private ' || c_custkey, '2001-01-01 20:00:00', c_name, c_custkey, 1 FROM customer
        WHERE 'Private ' || c_custkey NOT IN (SELECT event_id FROM saved)
    UNION ALL SELECT * FROM saved""",
)(lambda t, read: changes.save_events(with_private_events(t, read), event_forms(read), "b").tables["event"])
