"""Check queries with their SQL counterparts. Candidates are derived from whole test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.columns import valid_seat_number
from boxoffice.operators import candidates, checks
from boxoffice.plans.registry import query
from boxoffice.plans.report_queries import AS_OF, TS, stamp
from boxoffice.schemas import TABLES

# Candidate frames, in Spark and as SQL views.


def user_candidates(read) -> DataFrame:
    """New names that repeat, clash with customers but for case, or have bad characters or short passwords."""
    return read("events").selectExpr(
        "event_id AS seq",
        "-1 - event_id AS user_id",
        """CASE event_type WHEN 'click' THEN concat('click', user_id) WHEN 'signup' THEN concat('VIEW', user_id)
            WHEN 'view' THEN concat('  View', user_id, ' ') WHEN 'purchase' THEN concat('CUSTOMER', lpad(user_id, 9, '0'))
            ELSE if(value > 20, concat('err_', user_id), NULL) END AS username""",
        "if(value < 5, 'short', concat(event_type, '-password')) AS password",
    )


def ticket_requests(read) -> DataFrame:
    return read("events").selectExpr(
        "event_id AS seq",
        "if(event_type = 'error', -1L, user_id * 3) AS torder_id",
        "cast(floor(value * 10) AS bigint) AS tcategory_id",
        "if(event_type IN ('view', 'signup'), NULL, user_id * 7) AS seat_id",
    )


def redemptions(read) -> DataFrame:
    return read("events").selectExpr(
        "event_id AS seq", "user_id AS promotion_id", "cast(floor(value * 40) AS bigint) AS order_id"
    )


EVENT_OF = """concat('Brand#', user_id % 30, ' ', CASE event_type WHEN 'click' THEN 'ECONOMY' WHEN 'view' THEN 'SMALL'
    WHEN 'signup' THEN 'PROMO' WHEN 'purchase' THEN 'LARGE' ELSE 'GIANT' END)"""

CANDIDATES = {
    "c_user": """SELECT event_id AS seq, -1 - event_id AS user_id, trim(CASE event_type WHEN 'click' THEN 'click' || user_id
        WHEN 'signup' THEN 'VIEW' || user_id WHEN 'view' THEN '  View' || user_id || ' '
        WHEN 'purchase' THEN 'CUSTOMER' || lpad(CAST(user_id AS VARCHAR), 9, '0')
        ELSE CASE WHEN value > 20 THEN 'err_' || user_id END END) AS username,
        CASE WHEN value < 5 THEN 'short' ELSE event_type || '-password' END AS password FROM events""",
    "c_ticket": """SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN -1 ELSE user_id * 3 END AS torder_id,
        CAST(floor(value * 10) AS BIGINT) AS tcategory_id,
        CASE WHEN event_type IN ('view', 'signup') THEN NULL ELSE user_id * 7 END AS seat_id FROM events""",
    "c_use": """SELECT event_id AS seq, user_id AS promotion_id, CAST(floor(value * 40) AS BIGINT) AS order_id FROM events""",
    "c_event": """SELECT *, 'Brand#' || (user_id % 30) || ' ' || CASE event_type WHEN 'click' THEN 'ECONOMY' WHEN 'view' THEN 'SMALL'
        WHEN 'signup' THEN 'PROMO' WHEN 'purchase' THEN 'LARGE' ELSE 'GIANT' END AS show_id FROM events""",
}


def verdicts(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, "accepted", F.coalesce("reason", F.lit("ok")).alias("reason"))


query(
    "v01_check_usernames",
    """WITH judged AS (
        SELECT seq, lower(username) AS k, username, password,
            coalesce(regexp_full_match(username, '[a-zA-Z0-9]+'), FALSE) AS formed, length(password) >= 8 AS long_enough,
            lower(username) IN (SELECT lower(username) FROM b_user) AS old
        FROM c_user),
    firsts AS (SELECT k, min(seq) AS first FROM judged WHERE formed AND long_enough AND NOT old GROUP BY k)
    SELECT j.seq, j.username IS NOT NULL AND formed AND NOT old AND (first IS NULL OR first >= seq) AND long_enough AS accepted,
        CASE WHEN j.username IS NULL THEN CASE WHEN long_enough THEN 'missing_username' ELSE 'short_password' END
            WHEN NOT formed THEN 'bad_characters' WHEN old OR first < seq THEN 'duplicate_username'
            WHEN NOT long_enough THEN 'short_password' ELSE 'ok' END AS reason
    FROM judged j LEFT JOIN firsts f ON f.k = j.k""",
    CANDIDATES,
)(lambda t, read: verdicts(candidates.check_usernames(t["user_account"], user_candidates(read)), "seq"))

query(
    "v02_check_venues",
    """WITH cand AS (SELECT event_id AS seq, -1 - event_id AS venue_id, 'customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS n,
        'nation_' || (event_id % 25) AS c FROM events),
    old AS (SELECT lower(venue_name) AS n, lower(city) AS c, min(venue_id) AS id FROM b_venue GROUP BY ALL),
    j AS (SELECT cand.*, old.id AS old_id FROM cand LEFT JOIN old USING (n, c)),
    firsts AS (SELECT n, c, min(seq) AS first FROM j WHERE old_id IS NULL GROUP BY ALL)
    SELECT j.seq, coalesce(old_id, CASE WHEN first < seq THEN -1 - first END, 0) AS existing_id,
        old_id IS NULL AND first = seq AS accepted,
        CASE WHEN old_id IS NULL AND first = seq THEN 'ok' ELSE 'duplicate_venue' END AS reason
    FROM j LEFT JOIN firsts USING (n, c)""",
)(
    lambda t, read: verdicts(
        candidates.check_venues(
            t["venue"],
            read("events").selectExpr(
                "event_id AS seq",
                "-1 - event_id AS venue_id",
                "concat('customer#', lpad(user_id, 9, '0')) AS venue_name",
                "concat('nation_', event_id % 25) AS city",
            ),
        ).withColumn("existing_id", F.coalesce("existing_id", F.lit(0).cast("long"))),
        "seq",
        "existing_id",
    )
)
query(
    "v03_check_venue_deletes",
    f"""SELECT c.c_custkey * 2 AS venue_id, count(e.event_id) AS events, count(e.event_id) FILTER (e.event_datetime >= {TS}) AS active_events,
        v.venue_id IS NOT NULL AND count(e.event_id) = 0 AS accepted,
        CASE WHEN v.venue_id IS NULL THEN 'unknown_venue' WHEN count(e.event_id) FILTER (e.event_datetime >= {TS}) > 0 THEN 'active_events'
            WHEN count(e.event_id) > 0 THEN 'has_events' ELSE 'ok' END AS reason
    FROM customer c LEFT JOIN b_venue v ON v.venue_id = c.c_custkey * 2 LEFT JOIN b_event e ON e.venue_id = c.c_custkey * 2
    GROUP BY c.c_custkey, v.venue_id""",
)(
    lambda t, read: verdicts(
        candidates.check_venue_deletes(t, read("customer").selectExpr("c_custkey * 2 AS venue_id"), AS_OF),
        "venue_id",
        "events",
        "active_events",
    )
)
query(
    "v04_check_event_artists",
    """WITH cand AS (SELECT event_id AS seq, show_id AS event_id, CAST(floor(value * 2) AS BIGINT) AS artist_id FROM c_event),
    j AS (SELECT c.*, a.artist_id IS NULL AS no_artist, e.event_id IS NULL AS no_event, l.event_id IS NOT NULL AS linked
        FROM cand c LEFT JOIN b_artist a USING (artist_id) LEFT JOIN b_event e ON e.event_id = c.event_id
        LEFT JOIN b_event_artist l ON l.event_id = c.event_id AND l.artist_id = c.artist_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY event_id, artist_id, no_artist OR no_event OR linked ORDER BY seq) AS n FROM j)
    SELECT seq, NOT (no_artist OR no_event OR linked) AND n = 1 AS accepted,
        CASE WHEN no_artist THEN 'unknown_artist' WHEN no_event THEN 'unknown_event' WHEN linked OR n > 1 THEN 'duplicate_link'
            ELSE 'ok' END AS reason FROM r""",
    CANDIDATES,
)(
    lambda t, read: verdicts(
        candidates.check_event_artists(
            t,
            read("events").selectExpr(
                "event_id AS seq", f"{EVENT_OF} AS event_id", "cast(floor(value * 2) AS bigint) AS artist_id"
            ),
        ),
        "seq",
    )
)
query(
    "v05_admit_redemptions",
    """WITH dates AS (SELECT k.torder_id AS order_id, CAST(min(e.event_datetime) AS DATE) AS d FROM b_ticket k
        JOIN b_category g ON g.category_id = k.tcategory_id JOIN b_event e ON e.event_id = g.tevent_id GROUP BY ALL),
    used AS (SELECT promotion_id, count(*) AS used FROM b_use GROUP BY ALL),
    j AS (SELECT c.seq, c.promotion_id, p.usage_limit, coalesce(u.used, 0) AS used, o.order_id IS NOT NULL AS known,
            coalesce(d.d < p.start_date OR d.d > p.end_date, FALSE) AS outside
        FROM c_use c LEFT JOIN b_promotion p USING (promotion_id) LEFT JOIN used u USING (promotion_id)
        LEFT JOIN b_order o ON o.order_id = c.order_id LEFT JOIN dates d ON d.order_id = c.order_id),
    r AS (SELECT *, used + coalesce(sum(CASE WHEN usage_limit IS NOT NULL AND known AND NOT outside THEN 1 ELSE 0 END)
            OVER (PARTITION BY promotion_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j),
    v AS (SELECT seq, CASE WHEN usage_limit IS NULL THEN 'unknown_promotion' WHEN before >= usage_limit THEN 'limit_reached'
        WHEN outside THEN 'outside_dates' WHEN NOT known THEN 'unknown_order' ELSE 'ok' END AS reason FROM r)
    SELECT seq, reason = 'ok' AS accepted, reason FROM v""",
    CANDIDATES,
)(lambda t, read: verdicts(candidates.admit_redemptions(t, redemptions(read)), "seq"))
query(
    "v06_check_seat_deletes",
    """SELECT ev.event_id * 2 AS seat_id, s.seat_id IS NOT NULL AND l.seat_id IS NULL AS accepted,
        CASE WHEN s.seat_id IS NULL THEN 'unknown_seat' WHEN l.seat_id IS NOT NULL THEN 'seat_taken' ELSE 'ok' END AS reason
    FROM events ev LEFT JOIN b_seat s ON s.seat_id = ev.event_id * 2
    LEFT JOIN (SELECT DISTINCT seat_id FROM b_link) l ON l.seat_id = ev.event_id * 2""",
)(
    lambda t, read: verdicts(
        candidates.check_seat_deletes(t, read("events").selectExpr("event_id * 2 AS seat_id")), "seat_id"
    )
)

QUOTA_SQL = """WITH sold AS (SELECT tcategory_id, count(*) AS sold FROM b_ticket GROUP BY ALL),
    j AS (SELECT c.seq, c.tcategory_id, g.quota, coalesce(s.sold, 0) AS sold, o.order_id IS NOT NULL AS known
        FROM c_ticket c LEFT JOIN b_category g ON g.category_id = c.tcategory_id LEFT JOIN sold s ON s.tcategory_id = c.tcategory_id
        LEFT JOIN b_order o ON o.order_id = c.torder_id),
    r AS (SELECT *, sold + coalesce(sum(CASE WHEN known AND quota IS NOT NULL THEN 1 ELSE 0 END)
            OVER (PARTITION BY tcategory_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j),
    v AS (SELECT seq, CASE WHEN before >= quota THEN 'quota_full' WHEN quota IS NULL THEN 'unknown_category'
        WHEN NOT known THEN 'unknown_order' ELSE 'ok' END AS reason FROM r)
    SELECT seq, reason = 'ok' AS accepted, reason FROM v"""
query("v07_admit_tickets", QUOTA_SQL, CANDIDATES)(
    lambda t, read: verdicts(candidates.admit_tickets(t, ticket_requests(read)), "seq")
)
query(
    "v08_check_duplicate_tickets",
    """WITH j AS (SELECT c.seq, c.torder_id, c.tcategory_id, min(k.ticket_code) AS code FROM c_ticket c
        LEFT JOIN b_ticket k ON k.torder_id = c.torder_id AND k.tcategory_id = c.tcategory_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY torder_id, tcategory_id ORDER BY seq) AS n FROM j)
    SELECT seq, coalesce(code, 'none') AS existing_code, code IS NULL AND n = 1 AS accepted,
        CASE WHEN code IS NULL AND n = 1 THEN 'ok' ELSE 'duplicate_ticket' END AS reason FROM r""",
    CANDIDATES,
)(
    lambda t, read: verdicts(
        candidates.check_duplicate_tickets(t, ticket_requests(read)).fillna("none", ["existing_code"]),
        "seq",
        "existing_code",
    )
)
query(
    "v09_check_seat_free",
    """WITH r AS (SELECT seq, seat_id, seat_id IN (SELECT seat_id FROM b_link) AS old,
        row_number() OVER (PARTITION BY seat_id ORDER BY seq) AS n FROM c_ticket)
    SELECT seq, seat_id IS NULL OR (NOT old AND n = 1) AS accepted,
        CASE WHEN seat_id IS NULL OR (NOT old AND n = 1) THEN 'ok' ELSE 'seat_taken' END AS reason FROM r""",
    CANDIDATES,
)(lambda t, read: verdicts(candidates.check_seat_free(t, ticket_requests(read)), "seq"))
query(
    "v09_seats_with_many_tickets",
    "SELECT seat_id, count(*) AS tickets FROM b_link GROUP BY seat_id HAVING count(*) > 1",
)(lambda t, read: candidates.seats_with_many_tickets(t))
query(
    "v10_check_seats",
    """WITH cand AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN -1 - o_orderkey ELSE o_orderkey END AS seat_id,
        lower(o_orderpriority) AS section, o_orderstatus AS row_number, o_custkey AS venue_id,
        CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey % 10 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS num FROM orders),
    j AS (SELECT c.*, NOT regexp_full_match(num, '[0-9]+') OR CAST(num AS BIGINT) < 1 AS bad, s.seat_id AS old_id
        FROM cand c LEFT JOIN b_seat s ON s.venue_id = c.venue_id AND lower(s.section) = c.section AND s."row_number" = c."row_number"
            AND s.seat_number = c.num AND s.seat_id <> c.seat_id),
    f AS (SELECT venue_id, section, "row_number", num, min(seq) AS first FROM j WHERE NOT bad AND old_id IS NULL GROUP BY ALL),
    v AS (SELECT j.seq, CASE WHEN bad THEN 'bad_seat_number' WHEN old_id IS NOT NULL OR first < j.seq THEN 'duplicate_seat' ELSE 'ok' END AS reason
        FROM j LEFT JOIN f USING (venue_id, section, "row_number", num))
    SELECT seq, reason = 'ok' AS accepted, reason FROM v""",
)(
    lambda t, read: verdicts(
        candidates.check_seats(
            t,
            read("orders").selectExpr(
                "o_orderkey AS seq",
                "if(o_orderstatus = 'F', -1 - o_orderkey, o_orderkey) AS seat_id",
                "lower(o_orderpriority) AS section",
                "o_orderstatus AS row_number",
                "o_custkey AS venue_id",
                "cast(if(o_orderstatus = 'P', o_custkey % 10, o_orderkey) AS string) AS seat_number",
            ),
        ),
        "seq",
    )
)
query(
    "v11_valid_seat_number",
    """SELECT event_id, replace(props[7:], '}', '') AS text,
    regexp_full_match(replace(props[7:], '}', ''), '[0-9]+') AND CAST(replace(props[7:], '}', '') AS BIGINT) >= 1 AS valid FROM events""",
)(
    lambda t, read: read("events")
    .selectExpr("event_id", "replace(substring(props, 7), '}', '') AS text")
    .withColumn("valid", valid_seat_number(F.col("text")))
)
query(
    "v12_check_rules",
    """SELECT 'venue' AS source, venue_id AS id, 'check:capacity_check' AS reason FROM b_venue WHERE capacity <= 0
    UNION ALL SELECT 'event', event_id, CASE WHEN user_id % 5 = 0 AND event_type = 'error' THEN 'check:quota_check,check:price_check'
        WHEN user_id % 5 = 0 THEN 'check:quota_check' ELSE 'check:price_check' END
    FROM events WHERE user_id % 5 = 0 OR event_type = 'error'""",
)(
    lambda t, read: _broken(checks.check_rules(t["venue"], "venue"), "venue", "venue_id").unionByName(
        _broken(
            checks.check_rules(
                read("events").selectExpr(
                    "event_id",
                    "cast(user_id % 5 AS int) AS quota",
                    "if(event_type = 'error', -1 - value, if(event_type = 'view', NULL, value)) AS price",
                ),
                "ticket_category",
            ),
            "event",
            "event_id",
        )
    )
)


def _broken(checked: DataFrame, source: str, key: str) -> DataFrame:
    return checked.filter(~F.col("accepted")).select(
        F.lit(source).alias("source"), F.col(key).alias("id"), "reason"
    )


query(
    "v13_check_not_null",
    "SELECT seq, 'null:username' AS reason FROM c_user WHERE username IS NULL",
    CANDIDATES,
)(
    lambda t, read: checks.check_not_null(user_candidates(read), "user_account")
    .filter(~F.col("accepted"))
    .select("seq", "reason")
)
query(
    "v14_check_unique",
    """SELECT 'key:account_role(role_id, user_id)' AS "constraint", role_id || '|' || user_id AS "key", count(*) AS "rows"
    FROM b_account_role GROUP BY role_id, user_id HAVING count(*) > 1
    UNION ALL SELECT 'unique:account_role(user_id)', CAST(user_id AS VARCHAR), count(*) FROM b_account_role GROUP BY user_id HAVING count(*) > 1
    UNION ALL SELECT 'order and category', torder_id || '|' || tcategory_id, count(*) FROM b_ticket
    GROUP BY torder_id, tcategory_id HAVING count(*) > 1""",
)(
    lambda t, read: checks.check_keys(t, "account_role").unionByName(
        checks.check_unique(t["ticket"], ["torder_id", "tcategory_id"]).selectExpr(
            "'order and category' AS constraint", "concat_ws('|', torder_id, tcategory_id) AS key", "rows"
        )
    )
)
query(
    "v15_check_foreign_keys",
    """SELECT 'reference:ticket(tcategory_id) to ticket_category' AS "constraint", CAST(tcategory_id AS VARCHAR) AS "key", count(*) AS "rows"
    FROM c_ticket WHERE tcategory_id NOT IN (SELECT category_id FROM b_category) GROUP BY tcategory_id
    UNION ALL SELECT 'reference:ticket(torder_id) to order', CAST(torder_id AS VARCHAR), count(*)
    FROM c_ticket WHERE torder_id NOT IN (SELECT order_id FROM b_order) GROUP BY torder_id""",
    CANDIDATES,
)(lambda t, read: checks.check_foreign_keys(t.replace(ticket=ticket_requests(read)), "ticket"))
query(
    "v15_all_references",
    """SELECT 'reference:ticket(tcategory_id) to ticket_category' AS "constraint", CAST(tcategory_id AS VARCHAR) AS "key", count(*) AS "rows"
    FROM c_ticket WHERE tcategory_id NOT IN (SELECT category_id FROM b_category) GROUP BY tcategory_id
    UNION ALL SELECT 'reference:ticket(torder_id) to order', CAST(torder_id AS VARCHAR), count(*)
    FROM c_ticket WHERE torder_id NOT IN (SELECT order_id FROM b_order) GROUP BY torder_id
    UNION ALL SELECT 'reference:has_relationship(ticket_id) to ticket', ticket_id, count(*) FROM b_link
    WHERE ticket_id NOT IN (SELECT CAST(seq AS VARCHAR) FROM c_ticket) GROUP BY ticket_id""",
    CANDIDATES,
)(
    lambda t, read: checks.check_foreign_keys(
        t.replace(ticket=ticket_requests(read).withColumn("ticket_id", F.col("seq").cast("string")))
    )
)
query(
    "v16_check_lengths",
    """SELECT conv_id, turn, 'length:username' AS reason FROM conversations WHERE length(text) > 100""",
)(
    lambda t, read: checks.check_lengths(
        read("conversations").selectExpr("conv_id", "turn", "text AS username", "role AS password"), "user_account"
    )
    .filter(~F.col("accepted"))
    .select("conv_id", "turn", "reason")
)
query(
    "v18_check_events",
    f"""WITH cand AS (SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN '   ' ELSE event_type END AS title, ts,
        event_type = 'error' AS bad FROM events),
    v AS (SELECT seq, CASE WHEN trim(title) = '' THEN 'blank_title' WHEN bad THEN 'bad_date' ELSE 'ok' END AS reason,
        CASE WHEN bad THEN 'none' ELSE {stamp("date_trunc('minute', ts)")} END AS event_datetime FROM cand)
    SELECT seq, event_datetime, reason = 'ok' AS accepted, reason FROM v""",
)(
    lambda t, read: verdicts(
        candidates.check_events(
            read("events").selectExpr(
                "event_id AS seq",
                "if(event_type = 'view', '   ', event_type) AS title",
                "if(event_type = 'error', '2024-02-30', date_format(ts, 'yyyy-MM-dd')) AS date",
                "date_format(ts, 'H:mm') AS time",
            )
        ).withColumn(
            "event_datetime", F.coalesce(F.col("event_datetime").cast("string"), F.lit("none"))
        ),
        "seq",
        "event_datetime",
    )
)
query(
    "v19_check_event_owner",
    """WITH j AS (SELECT c.event_id AS seq, c.event_type, e.event_id AS known, o.user_id = c.user_id % 10 AS own
        FROM c_event c LEFT JOIN b_event e ON e.event_id = c.show_id LEFT JOIN b_organizer o USING (organizer_id)),
    v AS (SELECT seq, CASE WHEN event_type = 'signup' THEN 'no_access' WHEN known IS NULL THEN 'unknown_event'
        WHEN event_type <> 'purchase' AND NOT coalesce(own, FALSE) THEN 'not_owner' ELSE 'ok' END AS reason FROM j)
    SELECT seq, reason = 'ok' AS accepted, reason FROM v""",
    CANDIDATES,
)(
    lambda t, read: verdicts(
        candidates.check_event_owner(
            t,
            read("events").selectExpr(
                "event_id AS seq",
                f"{EVENT_OF} AS event_id",
                "user_id % 10 AS user_id",
                "CASE event_type WHEN 'signup' THEN 'customer' WHEN 'purchase' THEN 'administrator' ELSE 'organizer' END AS role",
            ),
        ),
        "seq",
    )
)


# All declared rules of all tables; the SQL is written from the same specs, rule by rule.

SQL_NAME = {"user_account": "b_user", "ticket_category": "b_category", "has_relationship": "b_link", "order_promotion": "b_use"}
NOT_IN_SQL = ("event_artist", "role")  # an optional column that the mapping leaves empty


def _counted(check):
    def run(t, read) -> DataFrame:
        found = []
        for name in TABLES:
            reason = F.explode(F.split("reason", ",")).alias("reason")
            found.append(check(t[name], name).filter("NOT accepted").select(F.lit(name).alias("source"), reason))
        return reduce(DataFrame.unionByName, found).groupBy("source", "reason").agg(F.count("*").alias("rows"))

    return run


def _counted_sql(rules) -> str:
    """``rules``: (table, reason, condition under which a row breaks it)."""
    rows = [
        f"SELECT '{table}' AS source, '{reason}' AS reason, count(*) AS \"rows\" FROM {SQL_NAME.get(table, 'b_' + table)} WHERE {broken} HAVING count(*) > 0"
        for table, reason, broken in rules
    ]
    return " UNION ALL ".join(rows)


query(
    "v12_rules_of_all_tables",
    _counted_sql((n, f"check:{rule}", f"NOT ({text})") for n, spec in TABLES.items() for rule, text in spec.rules.items()),
)(_counted(checks.check_rules))
query(
    "v13_nulls_of_all_tables",
    _counted_sql((n, f"null:{c.name}", f'"{c.name}" IS NULL') for n, spec in TABLES.items() for c in spec.columns if not c.nullable),
)(_counted(checks.check_not_null))
query(
    "v16_lengths_of_all_tables",
    _counted_sql(
        (n, f"length:{c.name}", f'length("{c.name}") > {c.length}')
        for n, spec in TABLES.items()
        for c in spec.columns
        if c.length and (n, c.name) != NOT_IN_SQL
    ),
)(_counted(checks.check_lengths))


def _keys_sql() -> str:
    found = []
    for name, spec in TABLES.items():
        for kind, keys in [("key", spec.key), *[("unique", u) for u in spec.unique]]:
            text = " || '|' || ".join(f'CAST("{k}" AS VARCHAR)' for k in keys)
            found.append(
                f"SELECT '{kind}:{name}({', '.join(keys)})' AS \"constraint\", {text} AS \"key\", count(*) AS \"rows\" "
                f"FROM {SQL_NAME.get(name, 'b_' + name)} WHERE {text} IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
            )
    return " UNION ALL ".join(found)


query("v14_keys_of_all_tables", _keys_sql())(
    lambda t, read: reduce(DataFrame.unionByName, [checks.check_keys(t, name) for name in TABLES])
)
