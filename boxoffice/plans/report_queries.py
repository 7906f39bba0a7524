"""Report queries with their SQL counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from boxoffice.operators import dashboards, events, orders, people, tickets
from boxoffice.operators.search import TrigramIndex
from boxoffice.plans.registry import query
from boxoffice.schemas import TABLES
from boxoffice.session import shared_dir

AS_OF = "1998-07-01"
TS = "TIMESTAMP '1998-07-01 00:00:00'"
DATE = "DATE '1998-07-01'"
USER = 9


def stamp(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def date_text(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d')"


query("r01_artist_directory", "SELECT artist_id, name, genre FROM b_artist WHERE name ILIKE '%_1%' OR genre ILIKE '%_1%'")(
    lambda t, read: events.artist_directory(t, "_1")
)
query(
    "r02_artist_totals",
    """SELECT count(DISTINCT a.genre) AS total_genres, count(DISTINCT ea.event_id) AS total_events
    FROM b_artist a LEFT JOIN b_event_artist ea USING (artist_id) WHERE a.name ILIKE '%7%' OR a.genre ILIKE '%7%'""",
)(lambda t, read: events.artist_totals(t, "7"))
query(
    "r04_category_report_totals",
    """SELECT coalesce(sum(c.quota), 0)::BIGINT AS total_quota, CAST(coalesce(max(c.price), 0) AS DOUBLE) AS highest_price
    FROM b_category c JOIN b_event e ON e.event_id = c.tevent_id WHERE c.category_name ILIKE '%ring%' OR e.event_title ILIKE '%ring%'""",
)(lambda t, read: events.category_report(t, "ring")[1])
query(
    "r03_category_directory",
    """SELECT c.category_id, c.category_name, c.quota, CAST(c.price AS DOUBLE) AS price, c.tevent_id, e.event_title
    FROM b_category c JOIN b_event e ON e.event_id = c.tevent_id
    WHERE c.category_name ILIKE '%ring%' OR e.event_title ILIKE '%ring%'""",
)(lambda t, read: events.category_directory(t, "ring"))
query(
    "r04_category_totals",
    """SELECT CAST(coalesce(sum(c.quota), 0) AS BIGINT) AS total_quota, CAST(coalesce(max(c.price), 0) AS DOUBLE) AS highest_price
    FROM b_category c JOIN b_event e ON e.event_id = c.tevent_id""",
)(lambda t, read: events.category_totals(t))
query(
    "r05_event_options",
    """SELECT event_id, event_title FROM b_event
    WHERE organizer_id = (SELECT organizer_id FROM b_organizer WHERE user_id = 9)""",
)(lambda t, read: events.event_options(t, "organizer", USER))
query(
    "r06_primary_role",
    """SELECT u.user_id, coalesce(r.role, 'guest') AS role FROM b_user u LEFT JOIN (
        SELECT ar.user_id, lower(r.role_name) AS role, row_number() OVER (PARTITION BY ar.user_id ORDER BY
            CASE lower(r.role_name) WHEN 'administrator' THEN 1 WHEN 'organizer' THEN 2 WHEN 'customer' THEN 3 ELSE 4 END) AS n
        FROM b_account_role ar JOIN b_role r USING (role_id)) r ON r.user_id = u.user_id AND r.n = 1""",
)(lambda t, read: people.primary_role(t))
query(
    "r07_earliest_events",
    f"""SELECT e.event_id, e.event_title, {stamp("e.event_datetime")} AS event_datetime, v.venue_name
    FROM b_event e JOIN b_venue v USING (venue_id) ORDER BY e.event_datetime, e.event_id LIMIT 3""",
)(lambda t, read: events.earliest_events(t))

ROLE_VIEW = {
    "b_best_role": """SELECT u.user_id, coalesce(min_by(lower(r.role_name), ar.role_id), 'guest') AS role
        FROM b_user u LEFT JOIN b_account_role ar USING (user_id) LEFT JOIN b_role r USING (role_id) GROUP BY u.user_id"""
}
query(
    "r08_user_profile",
    """SELECT p.user_id, u.username, p.role, CASE p.role WHEN 'administrator' THEN 'admin' WHEN 'organizer' THEN 'organizer'
        ELSE 'customer' END AS page_role, upper(p.role[1]) || p.role[2:] AS role_title,
        coalesce(c.full_name, 'none') AS full_name, coalesce(nullif(c.phone_number, ''), '-') AS phone_number,
        coalesce(o.organizer_name, 'none') AS organizer_name, coalesce(o.contact_email, 'none') AS contact_email,
        coalesce(CASE WHEN p.role = 'organizer' THEN o.organizer_name ELSE coalesce(nullif(c.full_name, ''), u.username) END, 'none')
            AS display_name,
        CASE p.role WHEN 'customer' THEN coalesce(c.full_name, 'User') WHEN 'organizer' THEN coalesce(o.organizer_name, 'User')
            ELSE u.username END AS page_name
    FROM b_best_role p JOIN b_user u USING (user_id) LEFT JOIN b_customer c ON c.user_id = p.user_id
    LEFT JOIN b_organizer o ON o.user_id = p.user_id""",
    ROLE_VIEW,
)(
    lambda t, read: people.user_profile(t)
    .drop("customer_id", "organizer_id")
    .fillna("none", ["full_name", "organizer_name", "contact_email", "display_name"])
)
query(
    "r09_active_ticket_count",
    f"""SELECT c.customer_id, count(x.order_id) AS active_tickets FROM b_customer c LEFT JOIN (
        SELECT o.customer_id, o.order_id FROM b_ticket k JOIN b_order o ON o.order_id = k.torder_id
        JOIN b_category g ON g.category_id = k.tcategory_id JOIN b_event e ON e.event_id = g.tevent_id
        WHERE e.event_datetime >= {TS}) x USING (customer_id) GROUP BY c.customer_id""",
)(lambda t, read: people.active_ticket_count(t, AS_OF))
query(
    "r10_order_count",
    """SELECT c.customer_id, count(DISTINCT o.order_id) AS order_count
    FROM b_customer c LEFT JOIN b_order o USING (customer_id) GROUP BY c.customer_id""",
)(lambda t, read: people.order_count(t))
query("r11_unexpired_promo_count", f"SELECT count(*) AS promo_count FROM b_promotion WHERE end_date >= {DATE}")(
    lambda t, read: orders.unexpired_promo_count(t, AS_OF)
)
query(
    "r12_customer_spend",
    """SELECT customer_id, CAST(s AS DOUBLE) AS spend, CASE WHEN s >= 1000000
        THEN 'Rp ' || printf('%.1f', round_even(CAST(s AS DOUBLE) / 1000000, 1)) || 'M'
        ELSE 'Rp ' || CAST(floor(s / 1000) AS BIGINT) || 'K' END AS spend_text
    FROM (SELECT c.customer_id, coalesce(sum(o.total_amount), 0) AS s
        FROM b_customer c LEFT JOIN b_order o USING (customer_id) GROUP BY c.customer_id)""",
)(lambda t, read: people.customer_spend(t))
query(
    "r13_next_tickets",
    f"""SELECT customer_id, place, ticket_id, event_title, {stamp("event_datetime")} AS event_datetime, venue_name, category_name
    FROM (SELECT o.customer_id, k.ticket_id, e.event_title, e.event_datetime, v.venue_name, g.category_name,
            CAST(row_number() OVER (PARTITION BY o.customer_id ORDER BY e.event_datetime, k.ticket_id) AS INTEGER) AS place
        FROM b_ticket k JOIN b_order o ON o.order_id = k.torder_id JOIN b_category g ON g.category_id = k.tcategory_id
        JOIN b_event e ON e.event_id = g.tevent_id JOIN b_venue v USING (venue_id) WHERE e.event_datetime >= {TS})
    WHERE place <= 2""",
)(lambda t, read: tickets.next_tickets(t, AS_OF))
query(
    "r14_organizer_event_count",
    """SELECT o.organizer_id, o.organizer_name, count(e.event_id) AS event_count
    FROM b_organizer o LEFT JOIN b_event e USING (organizer_id) GROUP BY ALL""",
)(lambda t, read: people.organizer_event_count(t))

REGISTER = f"""SELECT k.ticket_id, k.ticket_code, c.full_name AS customer_name, e.event_title, g.category_name,
    CAST(g.price AS DOUBLE) AS price, v.venue_name, v.city, {stamp("e.event_datetime")} AS event_datetime, k.torder_id, k.status
    FROM b_ticket k JOIN b_order o ON o.order_id = k.torder_id JOIN b_customer c USING (customer_id)
    JOIN b_category g ON g.category_id = k.tcategory_id JOIN b_event e ON e.event_id = g.tevent_id
    JOIN b_venue v ON v.venue_id = e.venue_id"""
query("r15_ticket_register", REGISTER)(lambda t, read: tickets.ticket_register(t, "administrator"))
query("r15_ticket_register_own", f"{REGISTER} WHERE c.user_id = {USER}")(
    lambda t, read: tickets.ticket_register(t, "customer", USER)
)
query(
    "r15_register_display",
    """SELECT k.ticket_id, k.ticket_code, e.event_title, strftime(e.event_datetime, '%d %b, %Y — %H:%M') AS starts,
        strftime(e.event_datetime, '%a, %d %b %Y') AS day_for_customers, strftime(e.event_datetime, '%d %b %Y') AS day_for_organizers,
        'Rp ' || CAST(CAST(round(g.price, 0) AS BIGINT) AS VARCHAR) AS price
    FROM b_ticket k JOIN b_order o ON o.order_id = k.torder_id JOIN b_customer c USING (customer_id)
    JOIN b_category g ON g.category_id = k.tcategory_id JOIN b_event e ON e.event_id = g.tevent_id
    JOIN b_venue v ON v.venue_id = e.venue_id""",
)(lambda t, read: tickets.register_display(tickets.ticket_register(t, "administrator")))
query(
    "r16_ticket_status_summary",
    f"""SELECT count(*) AS total_tickets, count(*) FILTER (status = 'VALID') AS valid_tickets,
    count(*) FILTER (status = 'TERPAKAI') AS used_tickets FROM ({REGISTER})""",
)(lambda t, read: tickets.ticket_status_summary(t, "administrator"))
query(
    "r17_paid_order_event",
    """SELECT DISTINCT ON (o.order_id) o.order_id, c.full_name, e.event_id, e.event_title,
        substr(CAST(o.order_id AS VARCHAR), 1, 8) || ' — ' || c.full_name || ' — ' || e.event_title AS display
    FROM b_order o JOIN b_customer c USING (customer_id) JOIN b_ticket k ON k.torder_id = o.order_id
    JOIN b_category g ON g.category_id = k.tcategory_id JOIN b_event e ON e.event_id = g.tevent_id
    WHERE o.payment_status = 'LUNAS' ORDER BY o.order_id, e.event_datetime, e.event_id""",
)(lambda t, read: orders.paid_order_event(t))
UTILISATION_SQL = """SELECT category_id, category_name || ' — Rp ' || format('{:,}', CAST(floor(price) AS BIGINT)) || ' — (' || used || '/'
        || quota || ')' AS display, tevent_id AS event_id, category_name, quota, used, jenis_seating = 'Reserved Seating' AS has_seat,
        used >= quota AS is_full
    FROM (SELECT g.category_id, g.category_name, g.price, g.quota, g.tevent_id, v.jenis_seating, count(k.ticket_id) AS used
        FROM b_category g JOIN b_event e ON e.event_id = g.tevent_id JOIN b_venue v USING (venue_id)
        LEFT JOIN b_ticket k ON k.tcategory_id = g.category_id GROUP BY ALL)"""
query("r18_category_utilisation", UTILISATION_SQL)(lambda t, read: tickets.category_utilisation(t))
query(
    "r19_free_seats",
    """SELECT seat_id, section || ' — Baris ' || row_number || ', No. ' || seat_number AS display, venue_id
    FROM b_seat WHERE seat_id NOT IN (SELECT seat_id FROM b_link)""",
)(lambda t, read: tickets.free_seats(t))
query(
    "r20_seat_inventory",
    """SELECT s.seat_id, s.section, s.row_number, s.seat_number, v.venue_name,
        CASE WHEN l.seat_id IS NOT NULL THEN 'TERISI' ELSE 'TERSEDIA' END AS status, v.venue_id
    FROM b_seat s JOIN b_venue v USING (venue_id) LEFT JOIN b_link l ON l.seat_id = s.seat_id""",
)(lambda t, read: tickets.seat_inventory(t))
query(
    "r21_seat_totals",
    """SELECT total_seats, taken_seats, total_seats - taken_seats AS free_seats
    FROM (SELECT count(*) AS total_seats FROM b_seat), (SELECT count(*) AS taken_seats FROM b_link)""",
)(lambda t, read: tickets.seat_totals(t))
query(
    "r22_venue_directory",
    """SELECT venue_id, venue_name, address, city, capacity, jenis_seating, jenis_seating = 'Reserved Seating' AS has_reserved_seating
    FROM b_venue WHERE (contains(upper(venue_name), '#00') OR contains(upper(address), '#00')) AND city = 'NATION_7'
    AND jenis_seating = 'Free Seating'""",
)(lambda t, read: events.venue_directory(t, "#00", "NATION_7", "Free Seating"))
query("r23_venue_cities", "SELECT DISTINCT city FROM b_venue")(lambda t, read: events.venue_cities(t))
query(
    "r24_venue_totals",
    """SELECT CAST(coalesce(sum(capacity), 0) AS BIGINT) AS total_capacity,
    count(*) FILTER (jenis_seating = 'Reserved Seating') AS reserved_count
    FROM b_venue WHERE contains(upper(venue_name), 'BUILD') OR contains(upper(address), 'BUILD')""",
)(lambda t, read: events.venue_totals(t, "build"))
query(
    "r25_event_catalog",
    f"""SELECT DISTINCT e.event_id, e.event_title, {stamp("e.event_datetime")} AS event_datetime, e.venue_id, e.organizer_id
    FROM b_event e JOIN b_event_artist ea USING (event_id)
    WHERE contains(upper(e.event_title), 'ECONOMY') AND ea.artist_id = 4""",
)(lambda t, read: events.event_catalog(t, "economy", artist_id=4))


def indexed(t, table: str, columns: list[str], kind: str) -> TrigramIndex:
    return TrigramIndex.build(t[table], TABLES[table].key[0], columns, kind, f"{shared_dir(t.spark)}/trigrams-{uuid.uuid4().hex}")


query(
    "r25_event_search_indexed",
    f"""SELECT event_id, event_title, {stamp("event_datetime")} AS event_datetime, venue_id, organizer_id FROM b_event
    WHERE contains(upper(event_title), 'SHOW OF BRAND#1')""",
)(
    lambda t, read: events.event_catalog(
        t.replace(event=indexed(t, "event", ["event_title"], "literal").narrowed(t["event"], "show OF brand#1")), "show OF brand#1"
    )
)
query("r01_artist_search_indexed", "SELECT artist_id, name, genre FROM b_artist WHERE name ILIKE '%supp%er#%7_%' OR genre ILIKE '%supp%er#%7_%'")(
    lambda t, read: events.artist_directory(
        t.replace(artist=indexed(t, "artist", ["name", "genre"], "wildcard").narrowed(t["artist"], "SUPP%er#%7_")), "SUPP%er#%7_"
    )
)

CARD_VIEWS = {
    "b_card": """SELECT e.event_id, CAST(0 AS BIGINT) AS page, e.event_title AS title,
        strftime(e.event_datetime, '%Y-%m-%d') AS date, strftime(e.event_datetime, '%H:%M') AS time, v.venue_name AS venue,
        e.venue_id, e.organizer_id, coalesce(a.artists, '') AS artists,
        replace(format('{:,}', CAST(round_even(CAST(coalesce(g.lowest, 0) AS DOUBLE), 0) AS BIGINT)), ',', '.') AS price,
        coalesce(g.categories, '') AS categories, coalesce(g.js, '[]') AS ticket_categories_json
        FROM b_event e JOIN b_venue v USING (venue_id)
        LEFT JOIN (SELECT ea.event_id, string_agg(a.name, ', ' ORDER BY a.name, a.artist_id) AS artists
            FROM b_event_artist ea JOIN b_artist a USING (artist_id) GROUP BY ea.event_id) a ON a.event_id = e.event_id
        LEFT JOIN (SELECT tevent_id, min(price) AS lowest,
            string_agg(category_name, ', ' ORDER BY price DESC, category_name, category_id) AS categories,
            '[' || string_agg('{"name":"' || category_name || '","price":' || CAST(price AS DOUBLE) || ',"quota":' || quota || '}',
                ',' ORDER BY price DESC, category_name, category_id) || ']' AS js
            FROM b_category GROUP BY tevent_id) g ON g.tevent_id = e.event_id"""
}
query("r26_event_cards", "SELECT * FROM b_card", CARD_VIEWS)(lambda t, read: events.event_cards(t))
query(
    "r27_organizer_events",
    "SELECT * FROM b_card WHERE organizer_id IN (SELECT organizer_id FROM b_organizer WHERE user_id = 9)",
    CARD_VIEWS,
)(lambda t, read: events.organizer_events(t, USER))
query("r27_all_events", "SELECT event_id, page, title, date, time, venue, price FROM b_card", CARD_VIEWS)(
    lambda t, read: events.all_events(t).select("event_id", "page", "title", "date", "time", "venue", "price")
)
query("r28_pick_venues", "SELECT venue_id, venue_name FROM b_venue")(lambda t, read: events.pick_list(t, "venues"))
query("r28_pick_artists", "SELECT artist_id, name FROM b_artist")(lambda t, read: events.pick_list(t, "artists"))
query("r28_pick_organizers", "SELECT organizer_id, organizer_name FROM b_organizer")(
    lambda t, read: events.pick_list(t, "organizers")
)
query(
    "r29_checkout_event",
    f"""SELECT e.event_id, e.event_title, {stamp("e.event_datetime")} AS event_datetime, v.venue_name, v.jenis_seating, v.venue_id
    FROM b_event e JOIN b_venue v USING (venue_id) WHERE e.event_datetime >= {TS}
    ORDER BY e.event_datetime, e.event_id LIMIT 1""",
)(lambda t, read: events.checkout_event(t, as_of=AS_OF))
query(
    "r30_event_categories",
    "SELECT tevent_id, category_id, category_name, quota, CAST(price AS DOUBLE) AS price FROM b_category",
)(lambda t, read: events.event_categories(t))
query(
    "r31_checkout_seats",
    """SELECT e.event_id, s.place, CAST(s.seat_id AS VARCHAR) AS seat_id, s.label
    FROM b_event e JOIN b_venue v USING (venue_id) JOIN (
        SELECT venue_id, seat_id, section || ' - Baris ' || row_number || ', No. ' || seat_number AS label,
            CAST(row_number() OVER (PARTITION BY venue_id ORDER BY section, "row_number", seat_number, seat_id) AS INTEGER) AS place
        FROM b_seat WHERE seat_id NOT IN (SELECT seat_id FROM b_link)) s ON s.venue_id = e.venue_id
    WHERE v.jenis_seating = 'Reserved Seating' AND s.place <= 24
    UNION ALL SELECT e.event_id, 1, 'tanpa_kursi', 'Tanpa Kursi' FROM b_event e JOIN b_venue v USING (venue_id)
    WHERE v.jenis_seating <> 'Reserved Seating'""",
)(lambda t, read: tickets.checkout_seats(t))
query(
    "r32_running_promotions",
    f"""SELECT promotion_id, promo_code, discount_type, CAST(discount_value AS DOUBLE) AS discount_value,
    {date_text("start_date")} AS start_date, {date_text("end_date")} AS end_date
    FROM b_promotion WHERE start_date <= {DATE} AND end_date >= {DATE}""",
)(lambda t, read: orders.running_promotions(t, AS_OF))
query(
    "r32_running_promotions_by_day",
    f"""SELECT DISTINCT {date_text("CAST(order_date AS DATE)")} AS day, promotion_id, promo_code, discount_type, CAST(discount_value AS DOUBLE) AS discount_value,
    {date_text("start_date")} AS start_date, {date_text("end_date")} AS end_date
    FROM b_promotion JOIN b_order ON CAST(order_date AS DATE) BETWEEN start_date AND end_date""",
)(lambda t, read: orders.running_promotions_by_day(t, t["order"].select(F.to_date("order_date").alias("day"))))


def carts(t, read):
    """A cart per event row: a part's event and name, a supplier's promo, quantities from 0 to 12."""
    wanted = read("events").selectExpr(
        "event_id AS cart_id", "cast(floor(value * 10) AS bigint) AS category_id", "cast(user_id % 13 AS int) AS quantity",
        "CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE concat('PROMO', user_id) END AS promo_code",
        "user_id AS customer_id",
    )
    named = t["ticket_category"].selectExpr("category_id", "tevent_id AS event_id", "category_name")
    return wanted.join(named, "category_id", "left").drop("category_id")


CART_VIEWS = {
    "b_cart": """SELECT ev.event_id AS cart_id, c.tevent_id AS event_id, c.category_name, CAST(ev.user_id % 13 AS INTEGER) AS quantity,
        CASE ev.event_type WHEN 'view' THEN NULL WHEN 'click' THEN '' ELSE 'PROMO' || ev.user_id END AS promo_code,
        ev.user_id AS customer_id
        FROM events ev LEFT JOIN b_category c ON c.category_id = CAST(floor(ev.value * 10) AS BIGINT)""",
    "b_priced": f"""SELECT c.cart_id, c.customer_id, c.quantity, CASE WHEN u.unit IS NULL THEN 'unknown_category'
            WHEN c.quantity <= 0 OR c.quantity > 10 THEN 'bad_quantity'
            WHEN coalesce(c.promo_code, '') <> '' AND p.promo_code IS NULL THEN 'bad_promo' ELSE 'ok' END AS verdict,
        u.unit * c.quantity AS base,
        CASE WHEN p.discount_type IS NULL THEN CAST(u.unit * c.quantity AS DECIMAL(14,2))
            WHEN p.discount_type = 'PERCENTAGE'
            THEN CAST((CAST(u.unit * 100 AS BIGINT) * c.quantity * (100 - CAST(p.discount_value AS BIGINT)) + 50) // 100
                AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2))
            ELSE greatest(0, u.unit * c.quantity - p.discount_value) END AS total
        FROM b_cart c
        LEFT JOIN (SELECT tevent_id, category_name, min(price) AS unit FROM b_category GROUP BY ALL) u
            ON u.tevent_id = c.event_id AND u.category_name = c.category_name
        LEFT JOIN (SELECT * FROM b_promotion WHERE start_date <= {DATE} AND end_date >= {DATE}) p ON p.promo_code = c.promo_code""",
}
query(
    "r33_price_carts",
    """SELECT cart_id, verdict, CASE WHEN verdict = 'ok' THEN CAST(base AS DOUBLE) ELSE -1.0 END AS base_price,
    CASE WHEN verdict = 'ok' THEN CAST(total AS DOUBLE) ELSE -1.0 END AS total_price FROM b_priced""",
    CART_VIEWS,
)(
    lambda t, read: orders.price_carts(t, carts(t, read), AS_OF).select(
        "cart_id",
        F.coalesce("reason", F.lit("ok")).alias("verdict"),
        F.coalesce(F.col("base_price").cast("double"), F.lit(-1.0)).alias("base_price"),
        F.coalesce(F.col("total_price").cast("double"), F.lit(-1.0)).alias("total_price"),
    )
)

LEDGER = f"""SELECT o.order_id, {stamp("o.order_date")} AS order_date, o.payment_status, CAST(o.total_amount AS DOUBLE) AS total_amount,
    c.full_name AS customer_name, u.username AS customer_username
    FROM b_order o JOIN b_customer c USING (customer_id) JOIN b_user u ON u.user_id = c.user_id"""
query("r34_order_ledger", LEDGER)(lambda t, read: orders.order_ledger(t))
query(
    "r34_ledger_display",
    """SELECT o.order_id, CASE WHEN length(CAST(o.order_id AS VARCHAR)) > 13 THEN left(CAST(o.order_id AS VARCHAR), 12) || '…'
        ELSE CAST(o.order_id AS VARCHAR) END AS short_id, upper(left(u.username, 1)) AS initial, c.full_name AS customer_name,
        strftime(o.order_date, '%Y-%m-%d %H:%M') AS ordered_at, o.payment_status, CAST(o.total_amount AS DOUBLE) AS total_amount
    FROM b_order o JOIN b_customer c USING (customer_id) JOIN b_user u ON u.user_id = c.user_id""",
)(lambda t, read: orders.ledger_display(orders.order_ledger(t)))
query(
    "r35_order_totals",
    """SELECT count(*) AS total_orders, count(*) FILTER (payment_status = 'LUNAS') AS paid_orders,
    count(*) FILTER (payment_status = 'PENDING') AS pending_orders,
    CAST(sum(total_amount) FILTER (payment_status = 'LUNAS') AS DOUBLE) AS total_revenue FROM b_order""",
)(lambda t, read: orders.order_totals(t, "admin"))
query(
    "r34_order_report",
    f"""SELECT o.order_id, {stamp("o.order_date")} AS order_date, o.payment_status, CAST(o.total_amount AS DOUBLE) AS total_amount,
    c.full_name AS customer_name, u.username AS customer_username
    FROM b_order o JOIN b_customer c USING (customer_id) JOIN b_user u USING (user_id)""",
)(lambda t, read: orders.order_report(t, "admin")[0])
query(
    "r35_order_report_totals",
    """SELECT count(*) AS total_orders, count(*) FILTER (payment_status = 'LUNAS') AS paid_orders,
    count(*) FILTER (payment_status = 'PENDING') AS pending_orders,
    CAST(sum(total_amount) FILTER (payment_status = 'LUNAS') AS DOUBLE) AS total_revenue FROM b_order""",
)(lambda t, read: orders.order_report(t, "admin")[1])

USAGE = f"""SELECT p.promotion_id, p.promo_code, p.discount_type, CAST(p.discount_value AS DOUBLE) AS discount_value,
    {date_text("p.start_date")} AS start_date, {date_text("p.end_date")} AS end_date, p.usage_limit,
    count(u.order_promotion_id) AS current_usage FROM b_promotion p LEFT JOIN b_use u USING (promotion_id) GROUP BY ALL"""
query("r36_promotion_usage", USAGE)(lambda t, read: orders.promotion_usage(t))
query(
    "r37_promotion_totals",
    f"""SELECT count(*) AS total_promos, CAST(sum(current_usage) AS BIGINT) AS total_uses,
    count(*) FILTER (discount_type = 'PERCENTAGE') AS percentage_promos FROM ({USAGE})""",
)(lambda t, read: orders.promotion_totals(t))
query(
    "r38_remaining_quota",
    """SELECT g.tevent_id, g.category_id, g.category_name, CAST(g.quota - count(k.ticket_id) AS INTEGER) AS remaining
    FROM b_category g LEFT JOIN b_ticket k ON k.tcategory_id = g.category_id GROUP BY g.tevent_id, g.category_id, g.category_name, g.quota""",
)(lambda t, read: tickets.remaining_quota(t))
query(
    "r39_order_search",
    f"""SELECT * FROM ({LEDGER}) WHERE payment_status = 'LUNAS'
    AND (contains(CAST(order_id AS VARCHAR), '77') OR contains(upper(customer_name), '77'))""",
)(lambda t, read: orders.order_search(t, "77", "LUNAS"))
query("r40_promo_search", f"SELECT * FROM ({USAGE}) WHERE contains(upper(promo_code), 'PROMO1')")(
    lambda t, read: orders.promo_search(t, "promo1")
)

query("k01_user_count", "SELECT count(*) AS user_count FROM b_user")(lambda t, read: dashboards.user_count(t))
query(
    "k02_events_this_month",
    "SELECT count(*) AS events_this_month FROM b_event WHERE date_trunc('month', event_datetime) = DATE '1997-12-01'",
)(lambda t, read: dashboards.events_this_month(t, "1997-12-15"))
query(
    "k03_gross_volume",
    "SELECT CAST(sum(total_amount) AS DOUBLE) AS gross_volume FROM b_order WHERE payment_status = 'LUNAS'",
)(lambda t, read: dashboards.gross_volume(t))
query(
    "k04_running_promo_types",
    f"""SELECT p.discount_type, count(DISTINCT p.promotion_id) AS running_promos, count(u.order_promotion_id) AS uses
    FROM b_promotion p LEFT JOIN b_use u USING (promotion_id) WHERE p.start_date <= {DATE} AND p.end_date >= {DATE}
    GROUP BY p.discount_type""",
)(lambda t, read: dashboards.running_promo_types(t, AS_OF))
query(
    "k05_venue_figures",
    """SELECT count(*) AS venues, count(*) FILTER (jenis_seating = 'Reserved Seating') AS reserved_venues,
    max(capacity) AS largest_capacity FROM b_venue""",
)(lambda t, read: dashboards.venue_figures(t))
query(
    "k01_k05_admin_dashboard",
    f"""SELECT (SELECT count(*) FROM b_user) AS user_count,
    (SELECT count(*) FROM b_event WHERE date_trunc('month', event_datetime) = DATE '1998-07-01') AS events_this_month,
    (SELECT CAST(sum(total_amount) AS DOUBLE) FROM b_order WHERE payment_status = 'LUNAS') AS gross_volume,
    (SELECT count(*) FROM b_promotion WHERE start_date <= {DATE} AND end_date >= {DATE}) AS running_promos,
    (SELECT count(*) FROM b_use JOIN b_promotion USING (promotion_id) WHERE start_date <= {DATE} AND end_date >= {DATE}) AS promo_uses,
    (SELECT count(*) FROM b_venue) AS venues,
    (SELECT count(*) FROM b_venue WHERE jenis_seating = 'Reserved Seating') AS reserved_venues,
    (SELECT max(capacity) FROM b_venue) AS largest_capacity""",
)(lambda t, read: dashboards.admin_dashboard(t, AS_OF))
DASHBOARD_SQL = f"""SELECT o.organizer_id, o.organizer_name,
    (SELECT count(*) FROM b_event e WHERE e.organizer_id = o.organizer_id AND e.event_datetime >= {TS}) AS active_events,
    coalesce(s.sold, 0) AS tickets_sold, CAST(coalesce(s.revenue, 0) AS DOUBLE) AS revenue,
    (SELECT count(DISTINCT venue_id) FROM b_event e WHERE e.organizer_id = o.organizer_id) AS partner_venues
    FROM b_organizer o LEFT JOIN (
        SELECT e.organizer_id, count(*) AS sold, sum(g.price) AS revenue FROM b_ticket k
        JOIN b_order d ON d.order_id = k.torder_id AND d.payment_status = 'LUNAS'
        JOIN b_category g ON g.category_id = k.tcategory_id JOIN b_event e ON e.event_id = g.tevent_id
        GROUP BY e.organizer_id) s ON s.organizer_id = o.organizer_id"""
query("k06_k09_organizer_dashboard", DASHBOARD_SQL)(lambda t, read: dashboards.organizer_dashboard(t, AS_OF))
query(
    "k10_organizer_event_list",
    f"SELECT organizer_id, event_id, event_title, {stamp('event_datetime')} AS event_datetime FROM b_event",
)(lambda t, read: dashboards.organizer_event_list(t))
