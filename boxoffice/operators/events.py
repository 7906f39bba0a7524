"""Events, artists, ticket categories and venues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.functions.columns import (
    RESERVED,
    day_text,
    equals,
    literal_match,
    moment,
    narrowed,
    price_text,
    time_text,
    wildcard_match,
)
from boxoffice.operators.people import organizers_of
from boxoffice.operators.observed import with_totals
from boxoffice.operators.spread import side_by_side, spread_join
from boxoffice.sources.tables import Tables

CARD_ROWS = 1000
CARD_RANGES = 256  # ranges in which the lines of a long event are put in order


def artist_directory(t: Tables, q: str | None = None) -> DataFrame:
    found = narrowed(t["artist"], wildcard_match(q, "name", "genre"))
    return found.select("artist_id", "name", "genre").orderBy("name", "artist_id")


def artist_totals(t: Tables, q: str | None = None) -> DataFrame:
    """Distinct genres, and distinct events of the artists found."""
    found = narrowed(t["artist"], wildcard_match(q, "name", "genre"))
    genres = found.agg(F.countDistinct("genre").alias("total_genres"))
    events = (
        t["event_artist"]
        .join(found.select("artist_id"), "artist_id", "left_semi")
        .agg(F.countDistinct("event_id").alias("total_events"))
    )
    return side_by_side(genres, events)


def _categories_with_title(t: Tables, q: str | None) -> DataFrame:
    titles = t["event"].select(F.col("event_id").alias("tevent_id"), "event_title")
    joined = t["ticket_category"].join(titles, "tevent_id")
    return narrowed(joined, wildcard_match(q, "category_name", "event_title"))


def category_directory(t: Tables, q: str | None = None) -> DataFrame:
    return _category_rows(t, q).orderBy("event_title", "category_name", "category_id")


def _category_rows(t: Tables, q: str | None) -> DataFrame:
    return _categories_with_title(t, q).select("category_id", "category_name", "quota", "price", "tevent_id", "event_title")


def _category_figures() -> dict[str, Column]:
    return {"total_quota": F.coalesce(F.sum("quota"), F.lit(0)), "highest_price": F.coalesce(F.max("price"), F.lit(0).cast("decimal(12,2)"))}


def category_totals(t: Tables, q: str | None = None) -> DataFrame:
    return _categories_with_title(t, q).agg(*[c.alias(n) for n, c in _category_figures().items()])


def category_report(t: Tables, q: str | None = None) -> tuple[DataFrame, DataFrame]:
    """`category_directory`, unsorted, as a table, and `category_totals`, from one pass."""
    return with_totals(_category_rows(t, q), "categories", **_category_figures())


def event_options(t: Tables, role: str, user_id: object | None = None) -> DataFrame:
    """Events a role may choose from: administrators all, organizers their own, others none."""
    events = t["event"]
    if role == "organizer" and user_id is not None:
        events = events.join(organizers_of(t, user_id), "organizer_id", "left_semi")
    elif role not in ("administrator", "organizer"):
        events = events.filter(F.lit(False))
    return events.select("event_id", "event_title")


def _venue_names(t: Tables) -> DataFrame:
    return t["venue"].select("venue_id", "venue_name")


def earliest_events(t: Tables, n: int = 3) -> DataFrame:
    return (
        t["event"]
        .join(_venue_names(t), "venue_id")
        .orderBy("event_datetime", "event_id")
        .limit(n)
        .select("event_id", "event_title", "event_datetime", "venue_name")
    )


def event_catalog(
    t: Tables,
    search: str | None = None,
    venue_id: object | None = None,
    artist_id: object | None = None,
) -> DataFrame:
    """Events by title, venue and artist, by time."""
    events = narrowed(t["event"], literal_match(search, "event_title"), equals("venue_id", venue_id))
    if artist_id not in (None, ""):
        playing = t["event_artist"].filter(equals("artist_id", artist_id)).select("event_id")
        events = events.join(playing, "event_id", "left_semi")
    return events.select("event_id", "event_title", "event_datetime", "venue_id", "organizer_id").orderBy(
        "event_datetime", "event_id"
    )


def _in_pages(lines: DataFrame, line_id: str, entry: Column, page_rows: int) -> DataFrame:
    """Adds ``page``: the lines of an event in the order of ``entry``, cut every ``page_rows`` lines.

    An event of one page needs no order here, as the lists are sorted. A longer one is cut into about `CARD_RANGES`
    ranges, between lines chosen by the hash of their id, so the plan is lazy and no window group holds the
    whole event. A line's position is its place in its range plus the sizes of the ranges before.
    """
    sizes = lines.groupBy("event_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > page_rows)
    dealt = spread_join(lines, sizes, ["event_id"], line_id)
    short, long = dealt.filter("_n IS NULL").drop("_n"), spread_join(lines, sizes, ["event_id"], line_id, "inner")
    chosen = F.pmod(F.xxhash64(line_id), F.ceil(F.col("_n") / CARD_RANGES)) == 0
    bounds = long.filter(chosen).groupBy("event_id").agg(F.collect_list(entry).alias("_bounds"))
    ranged = spread_join(long, bounds, ["event_id"], line_id)
    ranged = ranged.withColumn("_range", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= entry)), F.lit(0))).drop("_bounds", "_n")
    counts = ranged.groupBy("event_id", "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy("event_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("event_id", "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("event_id", "_range").orderBy(entry)
    placed = ranged.withColumn("_place", F.row_number().over(inside)).join(starts, ["event_id", "_range"])
    page = F.floor((F.col("_place") + F.col("_start") - 1) / page_rows)
    paged = placed.withColumn("page", page).drop("_range", "_place", "_start")
    return short.withColumn("page", F.lit(0).cast("bigint")).unionByName(paged)


def _page_lists(paged: DataFrame, entry, out: str) -> DataFrame:
    """One sorted list per event and page; no list grows beyond a page."""
    return paged.groupBy("event_id", "page").agg(F.array_sort(F.collect_list(entry)).alias(out))


def _category_json(c) -> Column:
    """Prices with one decimal at least, never in powers of ten."""
    name = F.to_json(F.array(c["category_name"]))
    price = F.regexp_replace(c["price"].cast("decimal(12,2)").cast("string"), "0$", "")
    parts = [F.lit('{"name":'), F.substring(name, F.lit(2), F.length(name) - 2), F.lit(',"price":'), price]
    return F.concat(*parts, F.lit(',"quota":'), c["quota"].cast("string"), F.lit("}"))


def event_cards(t: Tables, events: DataFrame | None = None, page_rows: int = CARD_ROWS) -> DataFrame:
    """One card per event: artists by name, categories by falling price, lowest price, categories as JSON.

    The entries of an event fill pages of ``page_rows`` in that order, so pages 0, 1, .. read in sequence
    are the ordered lists. No entry is left out, and no row grows without end.
    """
    events = t["event"] if events is None else events
    shown = events.select("event_id", "event_title", "event_datetime", "venue_id", "organizer_id").join(
        _venue_names(t), "venue_id"
    )
    wanted = shown.select("event_id")

    categories = (
        t["ticket_category"]
        .withColumnRenamed("tevent_id", "event_id")
        .join(wanted, "event_id", "left_semi")
        .select("event_id", "category_id", "category_name", "price", "quota")
    )
    lowest = categories.groupBy("event_id").agg(F.min("price").alias("lowest_price"))
    artists = (
        t["event_artist"]
        .select("event_id", "artist_id")
        .join(wanted, "event_id", "left_semi")
        .join(t["artist"].select("artist_id", "name"), "artist_id")
    )
    category_entry = F.struct((-F.col("price")).alias("falling"), "category_name", "category_id", "price", "quota")
    category_pages = _page_lists(_in_pages(categories, "category_id", category_entry, page_rows), category_entry, "cats")
    artist_entry = F.struct("name", "artist_id")
    artist_pages = _page_lists(_in_pages(artists, "artist_id", artist_entry, page_rows), artist_entry, "acts")

    none = F.array().cast("array<string>")
    price = F.coalesce("lowest_price", F.lit(0).cast("decimal(12,2)"))
    as_json = F.concat(F.lit("["), F.array_join(F.transform("cats", _category_json), ","), F.lit("]"))
    pages = category_pages.join(artist_pages, ["event_id", "page"], "full")
    return (
        shown.join(lowest, "event_id", "left")
        .join(pages, "event_id", "left")
        .select(
            "event_id",
            F.coalesce("page", F.lit(0)).alias("page"),
            F.col("event_title").alias("title"),
            day_text(F.col("event_datetime")).alias("date"),
            time_text(F.col("event_datetime")).alias("time"),
            F.col("venue_name").alias("venue"),
            "venue_id",
            "organizer_id",
            F.coalesce(F.transform("acts", lambda a: a["name"]), none).alias("artists"),
            price_text(price).alias("price"),
            F.coalesce(F.transform("cats", lambda c: c["category_name"]), none).alias("categories"),
            F.coalesce(as_json, F.lit("[]")).alias("ticket_categories_json"),
        )
        .orderBy("date", "time", "event_id", "page")
    )


def organizer_events(t: Tables, user_id: object) -> DataFrame:
    return event_cards(t, t["event"].join(organizers_of(t, user_id), "organizer_id", "left_semi"))


def all_events(t: Tables) -> DataFrame:
    return event_cards(t)


# Lists that the forms offer: table, columns, order.
PICK_LISTS = {
    "venues": ("venue", ["venue_id", "venue_name"], ["city", "venue_name", "venue_id"]),
    "artists": ("artist", ["artist_id", "name"], ["name", "artist_id"]),
    "organizers": ("organizer", ["organizer_id", "organizer_name"], ["organizer_name", "organizer_id"]),
}


def pick_list(t: Tables, name: str) -> DataFrame:
    table, columns, order = PICK_LISTS[name]
    return t[table].orderBy(*order).select(*columns)


def event_categories(t: Tables, event_id: object | None = None) -> DataFrame:
    """Categories by falling price and name, of one event or of each."""
    found = narrowed(t["ticket_category"], equals("tevent_id", event_id))
    return found.select("tevent_id", "category_id", "category_name", "quota", "price").orderBy(
        "tevent_id", F.desc("price"), "category_name", "category_id"
    )


def _venue_rows(t: Tables, search, city, seating) -> DataFrame:
    return narrowed(
        t["venue"],
        literal_match(search, "venue_name", "address"),
        equals("city", (city or "").strip()),
        equals("jenis_seating", (seating or "").strip()),
    )


def venue_directory(
    t: Tables, search: str | None = None, city: str | None = None, seating: str | None = None
) -> DataFrame:
    return (
        _venue_rows(t, search, city, seating)
        .select(
            "venue_id",
            "venue_name",
            "address",
            "city",
            "capacity",
            "jenis_seating",
            (F.col("jenis_seating") == RESERVED).alias("has_reserved_seating"),
        )
        .orderBy("city", "venue_name", "venue_id")
    )


def venue_cities(t: Tables) -> DataFrame:
    return t["venue"].select("city").distinct().orderBy("city")


def venue_totals(
    t: Tables, search: str | None = None, city: str | None = None, seating: str | None = None
) -> DataFrame:
    return _venue_rows(t, search, city, seating).agg(
        F.coalesce(F.sum("capacity"), F.lit(0)).alias("total_capacity"),
        F.count_if(F.col("jenis_seating") == RESERVED).alias("reserved_count"),
    )


def checkout_event(t: Tables, event_id: object | None = None, as_of=None) -> DataFrame:
    """The event asked for, else the next one from ``as_of`` on."""
    venue = t["venue"].select("venue_id", "venue_name", "jenis_seating")
    events = t["event"].join(venue, "venue_id")
    if event_id not in (None, ""):
        events = events.filter(equals("event_id", event_id))
    else:
        events = events.filter(F.col("event_datetime") >= moment(as_of))
    return (
        events.orderBy("event_datetime", "event_id")
        .limit(1)
        .select("event_id", "event_title", "event_datetime", "venue_name", "jenis_seating", "venue_id")
    )
