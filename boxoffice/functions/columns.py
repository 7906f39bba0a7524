"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and marks that labels and inputs use.
NO_SEAT = "tanpa_kursi"
NO_SEAT_LABEL = "Tanpa Kursi"
TAKEN, FREE = "TERISI", "TERSEDIA"
USED, VOID, VALID = "TERPAKAI", "VOID", "VALID"
RESERVED = "Reserved Seating"
DASH = " — "
ROLE_RANK = ("administrator", "organizer", "customer")
QUANTITY_LIMIT = 10


def moment(as_of: datetime | date | str) -> Column:
    """``as_of`` as a literal without a time zone."""
    return F.lit(str(as_of)).cast("timestamp_ntz")


def day(as_of: datetime | date | str) -> Column:
    return F.to_date(moment(as_of))


def day_text(stamp: Column) -> Column:
    """``yyyy-MM-dd`` of a time stamp without zone, whatever the zone of the session."""
    return F.substring(stamp.cast("string"), 1, 10)


def time_text(stamp: Column) -> Column:
    """``HH:mm``."""
    return F.substring(stamp.cast("string"), 12, 5)


# Short names of months and of days from Sunday on
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
DAYS = "Sun Mon Tue Wed Thu Fri Sat".split()


def _named(number: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), number)


def day_display(stamp: Column) -> Column:
    """``15 Jun 2026``."""
    text = day_text(stamp)
    return F.concat_ws(" ", F.substring(text, 9, 2), _named(F.month(F.to_date(text)), MONTHS), F.substring(text, 1, 4))


def weekday_display(stamp: Column) -> Column:
    """``Mon, 15 Jun 2026``."""
    return F.concat_ws(", ", _named(F.dayofweek(F.to_date(day_text(stamp))), DAYS), day_display(stamp))


def moment_display(stamp: Column) -> Column:
    """``15 Jun, 2026 — 19:00``."""
    text = day_text(stamp)
    date = F.concat(F.substring(text, 9, 2), F.lit(" "), _named(F.month(F.to_date(text)), MONTHS), F.lit(", "), F.substring(text, 1, 4))
    return F.concat_ws(DASH, date, time_text(stamp))


def whole_display(amount: Column) -> Column:
    """A whole number, halves away from zero, without marks between the thousands."""
    return F.round(amount, 0).cast("decimal(38,0)").cast("string")


def strip(col: Column) -> Column:
    """Cuts white space of every kind at both ends; ``trim`` would cut spaces only."""
    return F.btrim(col, F.lit(" \t\n\x0b\f\r"))


def blank(col: Column) -> Column:
    return col.isNull() | (col == "")


def or_else(col: Column, other: Column) -> Column:
    """``other`` where ``col`` is NULL or empty."""
    return F.coalesce(F.nullif(col, F.lit("")), other)


def wildcard_match(query: str | None, *cols: str) -> Column | None:
    """Case-insensitive search in which ``%`` and ``_`` of the query are wildcards. None: no filter."""
    query = (query or "").strip()
    return _any_of(cols, lambda c: F.col(c).ilike(f"%{query}%")) if query else None


def literal_match(query: str | None, *cols: str) -> Column | None:
    """Case-insensitive search for the query as it stands."""
    query = (query or "").strip()
    return _any_of(cols, lambda c: F.contains(F.upper(c), F.upper(F.lit(query)))) if query else None


def _any_of(cols, test) -> Column:
    found = test(cols[0])
    for name in cols[1:]:
        found = found | test(name)
    return found


def equals(col: str, value: object | None) -> Column | None:
    return None if value in (None, "") else F.col(col) == F.lit(value)


def narrowed(df, *conditions: Column | None):
    """``df`` under those conditions that are set."""
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def ticket_status(df_columns: list[str]) -> Column:
    """Status in one of three words. Tables written before the column existed count as valid."""
    if "status" not in df_columns:
        return F.lit(VALID)
    word = F.upper(strip(F.coalesce(F.col("status"), F.lit(VALID))))
    return F.when(word.isin(USED, VOID), word).otherwise(F.lit(VALID))


def grouped(amount: Column) -> Column:
    """Whole number with commas between the thousands."""
    return F.format_number(F.floor(amount), 0)


def price_text(amount: Column) -> Column:
    """Whole number (half to even) with dots between the thousands."""
    return F.translate(F.format_number(F.bround(amount, 0), 0), ",", ".")


def spend_text(amount: Column) -> Column:
    """``Rp 1.4M`` from a million on (half to even), else ``Rp 750K`` (cut)."""
    millions = F.bround(amount / F.lit(1000000), 1).cast("string")
    thousands = F.floor(amount / F.lit(1000)).cast("string")
    return F.when(amount >= 1000000, F.concat(F.lit("Rp "), millions, F.lit("M"))).otherwise(
        F.concat(F.lit("Rp "), thousands, F.lit("K"))
    )


def category_label() -> Column:
    use = F.concat(F.lit("("), F.col("used"), F.lit("/"), F.col("quota"), F.lit(")"))
    return F.concat_ws(DASH, F.col("category_name"), F.concat(F.lit("Rp "), grouped(F.col("price"))), use)


def order_label() -> Column:
    short = F.substring(F.col("order_id").cast("string"), 1, 8)
    return F.concat_ws(DASH, short, F.col("full_name"), F.col("event_title"))


def seat_label(separator: str) -> Column:
    place = F.concat(F.lit("Baris "), F.col("row_number"), F.lit(", No. "), F.col("seat_number"))
    return F.concat(F.col("section"), F.lit(separator), place)


def initial(col: Column, default: str) -> Column:
    return or_else(F.upper(F.left(col, F.lit(1))), F.lit(default))


def shortened(col: Column, width: int) -> Column:
    """At most ``width`` characters; a cut text ends in an ellipsis."""
    return F.when(F.length(col) > width, F.concat(F.left(col, F.lit(width - 1)), F.lit("…"))).otherwise(col)


def discounted(total: Column, kind: Column, value: Column) -> Column:
    """A percentage may go below zero, an amount stops at zero."""
    percent = total * (F.lit(1) - value / F.lit(100))
    amount = F.greatest(F.lit(0).cast("decimal(12,2)"), total - value)
    return F.when(kind == "PERCENTAGE", percent).otherwise(amount)


def valid_seat_number(col: Column) -> Column:
    """ASCII digits with a value of at least one, of any length."""
    return F.coalesce(col.rlike(r"\A[0-9]+\z") & col.rlike("[1-9]"), F.lit(False))


def event_moment(day_col: Column, time_col: Column) -> Column:
    """Time stamp of a day and a time as typed into a form; NULL if they do not parse."""
    text = F.concat(strip(day_col), F.lit(" "), strip(time_col))
    shaped = text.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}\z")
    return F.when(shaped, F.concat(text, F.lit(":00")).try_cast("timestamp_ntz"))


def stable_uuid(*parts: Column) -> Column:
    """Id from the digest of its parts: the same after any re-run of a task, unlike a random id."""
    pieces = [F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]
    digest = F.md5(F.concat_ws("\u0001", *pieces))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cut])


def ticket_code(ticket_id: Column) -> Column:
    """``TTK-`` and the first eight hex digits of the id."""
    return F.concat(F.lit("TTK-"), F.upper(F.substring(F.translate(ticket_id, "-", ""), 1, 8)))
