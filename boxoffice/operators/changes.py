"""Change sets: a table set and a frame of changes give new tables and the rejected rows.

Nothing is written in place. Ids that a job has to make up are digests of the batch name and the row's
``seq`` (or key), so a task that runs twice makes the same ids; a batch name must not be used twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.columns import VALID, blank, event_moment, stable_uuid, strip, ticket_code
from boxoffice.operators.candidates import check_usernames, quota_facts, seat_of
from boxoffice.operators.checks import (
    judged,
    length_violations,
    null_violations,
    rule_violations,
)
from boxoffice.operators.conflicts import COMPONENT_ROWS
from boxoffice.operators.moves import moved
from boxoffice.operators.orders import placed_orders
from boxoffice.operators.settle import settle
from boxoffice.operators.spread import only_keys_of, spread_join, without_keys_of
from boxoffice.schemas import TABLES, references_to
from boxoffice.session import staged
from boxoffice.sources.tables import Tables


@dataclass
class Rewrite:
    """How a change set changes one table: a function from its rows, or from some of them that include all rows with
    these ``keys``, to the rows after it. ``keys`` names the rows that go, come or change."""

    keys: DataFrame
    apply: Callable[[DataFrame], DataFrame]


@dataclass
class ChangeSet:
    """What happens to each table, the rows that were refused, each with a ``reason``, and, where rows are
    added, their ``ids`` by ``seq``.

    ``tables`` are the new tables as a whole; `sources.layout` rewrites the touched buckets only. Where several
    tables come from one verdict, the verdict is a table in the shared folder, computed once.
    """

    tables: dict[str, DataFrame]
    rejects: DataFrame
    rewrites: dict[str, Rewrite]
    ids: DataFrame | None = None

    @classmethod
    def of(cls, t: Tables, rewrites: dict[str, Rewrite], rejects: DataFrame, ids: DataFrame | None = None) -> ChangeSet:
        tables = {name: rewrite.apply(t[name]).select(*t[name].columns) for name, rewrite in rewrites.items()}
        return cls(tables, rejects, rewrites, ids)

    def apply(self, t: Tables) -> Tables:
        return t.replace(**self.tables)


def _adding(table: str, new: DataFrame) -> Rewrite:
    return Rewrite(new.select(TABLES[table].key[0]), lambda rows: rows.unionByName(new.select(*rows.columns)))


def _replacing(t: Tables, table: str, column: str, gone: DataFrame, new: DataFrame | None = None) -> Rewrite:
    """The rows whose ``column`` is in ``gone`` go, the ``new`` ones come."""
    key = TABLES[table].key[0]
    keys = gone.select(key) if key == column else only_keys_of(t[table].select(key, column), gone, {column: column}).select(key)
    if new is None:
        return Rewrite(keys, lambda rows: without_keys_of(rows, gone, [column]))
    return Rewrite(keys.unionByName(new.select(key)), lambda rows: without_keys_of(rows, gone, [column]).unionByName(new.select(*rows.columns)))


def _types(t: Tables, table: str) -> dict[str, str]:
    return dict(t[table].dtypes)


def _refused(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.filter(~F.col("accepted")).select(*columns, "reason")


def _latest(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One change per key: the last by ``seq``. Without ``seq``, changes of a key that differ are ``_ambiguous``."""
    rest = [c for c in changes.columns if c not in keys and c != "seq"]
    ordered = "seq" in changes.columns
    change = F.struct(*(["seq"] if ordered else []), *[F.col(c) for c in rest], F.lit(0).alias("_any"))
    last = changes.groupBy(*keys).agg(F.max(change).alias("_last"), F.min(change).alias("_least"))
    ambiguous = F.lit(False) if ordered else ~F.col("_last").eqNullSafe(F.col("_least"))
    kept = [c for c in changes.columns if c not in keys]
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in kept], ambiguous.alias("_ambiguous"))


def _parent_flags(t: Tables, table: str, df: DataFrame) -> tuple[DataFrame, list[tuple[Column, str]]]:
    """Looks up every parent that ``df`` refers to; a NULL reference passes."""
    rules = []
    for n, ref in enumerate(TABLES[table].references):
        if ref.column not in df.columns:
            continue
        flag = f"_parent{n}"
        parents = t.lookup(ref.parent, {ref.parent_column: ref.column}, df)
        df = spread_join(df, parents.select(F.col(ref.parent_column).alias(ref.column), F.lit(True).alias(flag)), [ref.column])
        missing = F.col(ref.column).isNotNull() & F.col(flag).isNull()
        rules.append((missing, f"reference:{ref.column}"))
    return df, rules


def _row_rules(table: str, columns: Sequence[str]) -> list[tuple[Column, str]]:
    """The declared rules of a row, one reason per kind."""
    kinds = {
        "null": null_violations(table, columns),
        "length": length_violations(table, columns),
        "check": rule_violations(table, columns),
    }
    return [(F.coalesce(*found).isNotNull(), kind) for kind, found in kinds.items() if found]


def _changed_rules(table: str, columns: Sequence[str]) -> list[tuple[Column, str]]:
    """Rules of a partial row: those whose columns are all there. Every rule of the model reads one column."""
    there = [r for r in TABLES[table].rules.values() if r.split()[0] in columns]
    checks = [(~F.coalesce(F.expr(r), F.lit(True)), "check") for r in there]
    nulls, lengths = null_violations(table, columns), length_violations(table, columns)
    kinds = [("null", nulls), ("length", lengths)]
    return [(F.coalesce(*found).isNotNull(), kind) for kind, found in kinds if found] + checks


def with_defaults(t: Tables, table: str, rows: DataFrame, batch: str) -> DataFrame:
    """All columns of the table, with defaults and made-up ids where a value is missing; ``_bad_type`` says
    that a value does not fit its column."""
    spec, types = TABLES[table], _types(t, table)
    specs = {c.name: c for c in (*spec.columns, *spec.optional)}
    filled, bad = [], F.lit(False)
    for name in t[table].columns:
        value = F.lit(None).cast(types[name])
        if name in rows.columns:
            value = F.col(name).try_cast(types[name])
            bad = bad | (F.col(name).isNotNull() & value.isNull())
        default = specs[name].default
        if default is not None:
            value = F.coalesce(value, F.lit(default).cast(types[name]))
        if spec.key == (name,) and types[name] == "string":
            value = F.coalesce(value, stable_uuid(F.lit(table), F.lit(batch), F.col("seq")))
        filled.append(value.alias(name))
    return rows.select("seq", *filled, bad.alias("_bad_type"))


def append_rows(t: Tables, table: str, rows: DataFrame, batch: str = "append") -> ChangeSet:
    """Appends rows in order of ``seq`` under all declared rules of the table."""
    spec = TABLES[table]
    full = with_defaults(t, table, rows, batch)
    columns = [c for c in full.columns if c != "_bad_type"]
    claims = {f"unique{n}": list(keys) for n, keys in enumerate((spec.key, *spec.unique))}
    old_rules = []
    for name, keys in claims.items():
        old = t.lookup(table, {k: k for k in keys}, full).select(*keys).distinct()
        full = spread_join(full, old.withColumn(f"_old_{name}", F.lit(True)), keys, "seq")
        old_rules.append((F.col(f"_old_{name}").isNotNull(), f"unique:{', '.join(keys)}"))
    full, parents = _parent_flags(t, table, full)
    own_rules = [(F.col("_bad_type"), "type"), *_row_rules(table, columns)]
    rules = [*own_rules, *old_rules, *parents]
    fine = ~reduce(lambda a, b: a | b, [F.coalesce(broken, F.lit(False)) for broken, _ in rules])
    settled = settle(full, fine, claims)
    taken = [(F.col(f"_taken_{name}"), f"unique:{', '.join(keys)}") for name, keys in claims.items()]
    done = judged(settled, [*own_rules, *old_rules, *taken, *parents])
    new = done.filter("accepted")
    return ChangeSet.of(t, {table: _adding(table, new)}, _refused(done, columns), new.select("seq", *spec.key))


def _unique_flags(t: Tables, table: str, df: DataFrame, keys, fields, rules):
    """Looks up the owners of the unique values that a change would take."""
    taken = []
    for column in [u[0] for u in TABLES[table].unique if len(u) == 1 and u[0] in fields and len(keys) == 1]:
        owners = t[table].select(F.col(column).alias("_value"), keys[0])
        legal = ~reduce(lambda a, b: a | b, [F.coalesce(broken, F.lit(False)) for broken, _ in rules], F.lit(False))
        checked = moved(df.withColumn("_value", F.col(column)), owners, ["_value"], keys[0], legal)
        df = checked.withColumn(f"_taken_{column}", F.col("_taken")).drop("_taken", "existing_id", "_value")
        taken.append((F.col(f"_taken_{column}"), f"unique:{column}"))
    return df, taken


def update_rows(t: Tables, table: str, changes: DataFrame, key: Sequence[str] | None = None) -> ChangeSet:
    """Sets the other columns of ``changes`` on the rows with the same key; the last change of a key counts.

    A change that breaks a declared rule, names a parent that is not there, or takes a unique value of
    another row leaves the row as it was. Of two changes to the same unique value the earlier one counts.
    Without ``seq`` there is no last change, so different changes of one key are refused. The verdicts are a table
    in the shared folder; many steps read them.
    """
    keys = list(key or TABLES[table].key)
    latest = _latest(changes, keys)
    types = _types(t, table)
    fields = [c for c in t[table].columns if c in latest.columns and c not in keys]
    turn = F.col("seq") if "seq" in latest.columns else F.concat_ws("|", *keys)
    bad = reduce(lambda a, b: a | b, [F.col(c).isNotNull() & F.col(c).try_cast(types[c]).isNull() for c in fields], F.lit(False))
    typed = [F.col(c).try_cast(types[c]).alias(c) for c in fields]
    cast = latest.select(*keys, *typed, turn.alias("seq"), "_ambiguous", bad.alias("_bad_type"))
    cast, parents = _parent_flags(t, table, cast)
    own_rules = [(F.col("_ambiguous"), "ambiguous_key"), (F.col("_bad_type"), "type")]
    rules = [*own_rules, *_changed_rules(table, [*keys, *fields]), *parents]
    cast, taken = _unique_flags(t, table, cast, keys, fields, rules)
    new = F.struct(*[F.col(c).alias(c) for c in fields])
    ready = judged(cast, [*rules, *taken])
    ready = staged(ready.select(*keys, new.alias("_new"), "reason"), "changes")

    def rewritten(rows: DataFrame) -> DataFrame:
        use = F.col("_new").isNotNull() & F.col("reason").isNull()
        return rows.join(ready, keys, "left").select(
            *[F.when(use, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]
        )

    changed, key = ready.filter("reason IS NULL").select(*keys), TABLES[table].key[0]
    if key not in keys:
        changed = only_keys_of(t[table].select(key, *keys), changed, {k: k for k in keys})
    known = t.lookup(table, {k: k for k in keys}, ready).select(*keys).distinct().withColumn("_known", F.lit(True))
    judged_changes = ready.join(known, keys, "left").withColumn(
        "reason", F.when(F.col("_known").isNull(), "unknown_key").otherwise(F.col("reason"))
    )
    refused = judged_changes.filter(F.col("reason").isNotNull()).select(*keys, "reason")
    return ChangeSet.of(t, {table: Rewrite(changed.select(key), rewritten)}, refused)


def _cascade(t: Tables, table: str, keys: DataFrame) -> tuple[list[DataFrame], list[tuple[str, str, DataFrame]]]:
    """Follows the references to the rows ``keys`` (``root, key``) of a table.

    Returns the roots that a restricting reference blocks, and per cascading reference the child table,
    its column and the parent keys to delete by.
    """
    blocked, deletes = [], []
    for child, ref in references_to(table):
        if ref.on_delete == "restrict":
            used = t[child.name].select(F.col(ref.column).alias("key")).distinct()
            blocked.append(keys.join(used, "key", "left_semi").select("root"))
            continue
        deletes.append((child.name, ref.column, keys))
        if references_to(child.name):
            own = t[child.name].select(F.col(ref.column).alias("key"), F.col(child.key[0]).alias("_child"))
            below = spread_join(own, keys, ["key"], how="inner").select("root", F.col("_child").alias("key"))
            more_blocked, more_deletes = _cascade(t, child.name, below)
            blocked += more_blocked
            deletes += more_deletes
    return blocked, deletes


def delete_rows(t: Tables, table: str, ids: DataFrame) -> ChangeSet:
    """Deletes rows by their whole key. Restricting references, also below cascading ones, block a row; others
    go along. No reference points at a table with a key of several columns."""
    whole = list(TABLES[table].key)
    if len(whole) > 1:
        asked = ids.select(*whole).distinct()
        unknown = without_keys_of(asked, t[table], whole).withColumn("reason", F.lit("unknown_key"))
        return ChangeSet.of(t, {table: Rewrite(asked.select(whole[0]), lambda rows: without_keys_of(rows, asked, whole))}, unknown)
    key = whole[0]
    asked = ids.select(key).distinct()
    present = asked.join(t[table].select(key), key, "left_semi").select(F.col(key).alias("root"))
    roots = present.withColumn("key", F.col("root"))
    blocked, deletes = _cascade(t, table, roots)
    kept = reduce(DataFrame.unionByName, blocked).distinct() if blocked else None

    def free(frame: DataFrame) -> DataFrame:
        return frame.join(kept, "root", "left_anti") if kept is not None else frame

    rewrites = {table: _replacing(t, table, key, free(roots).select(F.col("root").alias(key)))}
    for child, column, keys in deletes:
        more = _replacing(t, child, column, free(keys).select(F.col("key").alias(column)))
        rewrites[child] = _both(rewrites[child], more) if child in rewrites else more
    unknown = asked.join(t[table].select(key), key, "left_anti").withColumn("reason", F.lit("unknown_key"))
    rejects = unknown
    if kept is not None:
        rejects = unknown.unionByName(kept.select(F.col("root").alias(key), F.lit("in_use").alias("reason")))
    return ChangeSet.of(t, rewrites, rejects)


def replace_rows(t: Tables, table: str, gone: DataFrame, new: DataFrame) -> ChangeSet:
    """The rows with a key of ``gone`` go and the ``new`` ones come, under no rules; see `checks.check_changes`."""
    return ChangeSet.of(t, {table: _replacing(t, table, TABLES[table].key[0], gone, new)}, t.spark.createDataFrame([], "reason string"))


def _both(one: Rewrite, other: Rewrite) -> Rewrite:
    return Rewrite(one.keys.unionByName(other.keys), lambda rows: other.apply(one.apply(rows)))


def _named_artists(changes: DataFrame, id_type: str) -> Column:
    wanted = F.col("artist_ids")
    if id_type == "string":
        wanted = F.filter(wanted, lambda a: ~blank(a))
    return F.coalesce(F.filter(wanted, lambda a: a.isNotNull()), F.array().cast(f"array<{id_type}>"))


def _with_artist_flags(t: Tables, changes: DataFrame) -> DataFrame:
    """Adds ``_artists`` (ids without blanks) and ``_bad_artists`` (unknown or named twice)."""
    named = changes.withColumn("_artists", _named_artists(changes, _types(t, "artist")["artist_id"]))
    lines = named.select("seq", F.explode("_artists").alias("artist_id"))
    unknown = lines.join(t["artist"].select("artist_id"), "artist_id", "left_anti").select("seq").distinct()
    flagged = named.join(unknown.withColumn("_unknown", F.lit(True)), "seq", "left")
    twice = F.size(F.array_distinct("_artists")) < F.size("_artists")
    return flagged.withColumn("_bad_artists", F.col("_unknown").isNotNull() | twice).drop("_unknown")


def _artist_links(t: Tables, accepted: DataFrame) -> Rewrite:
    """Old links of the touched events out, the named artists in, without a role."""
    types = _types(t, "event_artist")
    new = accepted.select("event_id", F.explode("_artists").alias("artist_id"))
    new = new.withColumn("role", F.lit(None).cast(types["role"]))
    return _replacing(t, "event_artist", "event_id", accepted.select("event_id"), new)


def replace_event_artists(t: Tables, changes: DataFrame) -> ChangeSet:
    """``changes``: seq, event_id, artist_ids. An event with an unknown or doubled artist keeps its artists."""
    event = t["event"].select("event_id", F.lit(True).alias("_known"))
    latest = _latest(changes, ["event_id"])
    flagged = _with_artist_flags(t, latest).join(event, "event_id", "left")
    done = judged(flagged, [(F.col("_known").isNull(), "unknown_event"), (F.col("_bad_artists"), "bad_artists")])
    return ChangeSet.of(t, {"event_artist": _artist_links(t, done.filter("accepted"))}, _refused(done, ["seq", "event_id"]))


def _with_category_flags(t: Tables, changes: DataFrame) -> DataFrame:
    """Adds ``_lines`` (complete triples), ``_bad_categories`` and ``_sold`` (old categories have tickets)."""
    triples = F.arrays_zip("names", "prices", "quotas")
    filled = lambda x: ~blank(x["names"]) & ~blank(x["prices"]) & ~blank(x["quotas"])
    limit = next(c.length for c in TABLES["ticket_category"].columns if c.name == "category_name")
    typed = lambda x: F.struct(
        x["names"].alias("category_name"),
        x["prices"].try_cast("decimal(12,2)").alias("price"),
        x["quotas"].try_cast("int").alias("quota"),
    )
    bad = lambda x: F.coalesce(
        (x["price"] < 0) | (x["quota"] <= 0) | (F.length(x["category_name"]) > limit), F.lit(True)
    )
    none = F.array().cast("array<struct<category_name:string,price:decimal(12,2),quota:int>>")
    lines = F.coalesce(F.transform(F.filter(triples, filled), typed), none)
    checked = changes.withColumn("_lines", lines).withColumn("_bad_categories", F.exists("_lines", bad))
    sold = t["ticket"].select(F.col("tcategory_id").alias("category_id")).distinct()
    in_use = t["ticket_category"].join(sold, "category_id", "left_semi").select(F.col("tevent_id").alias("event_id"))
    return spread_join(checked, in_use.distinct().withColumn("_sold", F.lit(True)), ["event_id"], "seq")


def _category_rows(t: Tables, accepted: DataFrame, batch: str) -> Rewrite:
    """Old categories of the touched events out, the given ones in."""
    touched = accepted.select(F.col("event_id").alias("tevent_id"))
    lines = accepted.select("event_id", F.posexplode("_lines").alias("place", "line"))
    types = _types(t, "ticket_category")
    new = lines.select(
        stable_uuid(F.lit("category"), F.lit(batch), F.col("event_id"), F.col("place")).alias("category_id"),
        "line.category_name",
        F.col("line.quota").cast(types["quota"]).alias("quota"),
        F.col("line.price").cast(types["price"]).alias("price"),
        F.col("event_id").alias("tevent_id"),
    )
    if types["category_id"] != "string":
        raise TypeError(f"made-up ids are text, but ticket_category.category_id is {types['category_id']}")
    return _replacing(t, "ticket_category", "tevent_id", touched, new)


def replace_event_categories(t: Tables, changes: DataFrame, batch: str = "categories") -> ChangeSet:
    """``changes``: seq, event_id and the parallel arrays names, prices, quotas (texts of a form).

    A triple with a blank is left out, and the shortest array ends the list. Events with sold tickets
    and lists with a bad value keep their categories.
    """
    event = t["event"].select("event_id", F.lit(True).alias("_known"))
    flagged = _with_category_flags(t, _latest(changes, ["event_id"])).join(event, "event_id", "left")
    done = judged(
        flagged,
        [
            (F.col("_known").isNull(), "unknown_event"),
            (F.col("_sold").isNotNull(), "sold_categories"),
            (F.col("_bad_categories"), "bad_categories"),
        ],
    )
    rows = _category_rows(t, done.filter("accepted"), batch)
    return ChangeSet.of(t, {"ticket_category": rows}, _refused(done, ["seq", "event_id"]))


def judge_moves(t: Tables, changes: DataFrame) -> DataFrame:
    """Ticket changes with verdict, one by one: status and seat are judged before either applies, a seat must
    not belong to another ticket, and a ticket that moves gives up the seats it had. The changes are computed once;
    many steps read them."""
    changes = staged(changes, "changes")
    ticket = t["ticket"].select("ticket_id", F.lit(True).alias("_ticket"))
    seat = t["seat"].select(F.col("seat_id").alias("_seat"), F.lit(True).alias("_seat_known"))
    word = F.upper(F.coalesce("status", F.lit(VALID)))
    asked = changes.withColumn("_seat", seat_of(changes)).withColumn("_word", word)
    asked = spread_join(asked, only_keys_of(ticket, asked, {"ticket_id": "ticket_id"}), ["ticket_id"], "seq")
    asked = spread_join(asked, only_keys_of(seat, asked, {"_seat": "_seat"}), ["_seat"], "seq")
    no_seat = F.col("_seat").isNotNull() & F.col("_seat_known").isNull()
    limit = next(c.length for c in TABLES["ticket"].optional if c.name == "status")
    too_long = (F.length("_word") > limit) if "status" in t["ticket"].columns else F.lit(False)
    rules = [(F.col("_ticket").isNull(), "unknown_ticket"), (no_seat, "unknown_seat"), (too_long, "length")]
    fine = ~reduce(lambda a, b: a | b, [broken for broken, _ in rules])
    links = t["has_relationship"].select(F.col("seat_id").alias("_seat"), "ticket_id")
    done = moved(staged(asked, "asked"), links, ["_seat"], "ticket_id", fine)
    return judged(done, [*rules, (F.col("_seat").isNotNull() & F.col("_taken"), "seat_taken")]).select(
        *changes.columns, "_seat", "_word", "accepted", "reason"
    )


def update_tickets(t: Tables, changes: DataFrame) -> ChangeSet:
    """``changes``: seq, ticket_id, status, seat_id. Sets the status and moves the ticket to the seat.

    Old links of a ticket go; a blank seat or the no-seat word leaves it without one. Of several accepted
    changes of a ticket the last counts; a seat it had in between is free again.
    """
    done = staged(judge_moves(t, changes), "moves")
    last = _latest(done.filter("accepted").select("seq", "ticket_id", "_word", "_seat"), ["ticket_id"])
    rewrites = {}
    if "status" in t["ticket"].columns:
        words = last.select("ticket_id", "_word")
        stated = lambda rows: rows.join(words, "ticket_id", "left").withColumn("status", F.coalesce("_word", "status"))
        rewrites["ticket"] = Rewrite(words.select("ticket_id"), lambda rows: stated(rows).select(*rows.columns))
    new = last.filter(F.col("_seat").isNotNull()).select(F.col("_seat").alias("seat_id"), "ticket_id")
    rewrites["has_relationship"] = _replacing(t, "has_relationship", "ticket_id", last.select("ticket_id"), new)
    return ChangeSet.of(t, rewrites, _refused(done, changes.columns))


def judge_tickets(t: Tables, cand: DataFrame, batch: str = "tickets", component_rows: int = COMPONENT_ROWS) -> DataFrame:
    """Ticket requests (``seq, torder_id, tcategory_id, seat_id``) with id, code and verdict.

    One by one: no second ticket for order and category, seat free, quota left, and all references
    there. A refused request holds nothing, so a later one for the same pair, seat or place may pass.
    ``component_rows`` is that of `settle`.
    """
    made = stable_uuid(F.lit("ticket"), F.lit(batch), F.col("seq"))
    asked = staged(cand.withColumn("_seat", seat_of(cand)).withColumn("ticket_code", ticket_code(made)), "requests")
    yes = F.lit(True)
    old_pairs = only_keys_of(t["ticket"], asked, {"torder_id": "torder_id", "tcategory_id": "tcategory_id"})
    old_pairs = old_pairs.select("torder_id", "tcategory_id").distinct().withColumn("_old_pair", yes)
    old_codes = only_keys_of(t["ticket"], asked, {"ticket_code": "ticket_code"})
    old_codes = old_codes.select("ticket_code").distinct().withColumn("_old_code", yes)
    orders = t["order"].select(F.col("order_id").alias("torder_id"), yes.alias("_order"))
    seats = t["seat"].select(F.col("seat_id").alias("_seat"), yes.alias("_seat_known"))
    links = t["has_relationship"].select(F.col("seat_id").alias("_seat")).distinct().withColumn("_linked", yes)

    known = spread_join(asked, old_pairs, ["torder_id", "tcategory_id"], "seq")
    known = spread_join(known, quota_facts(t, asked), ["tcategory_id"], "seq")
    known = spread_join(known, orders, ["torder_id"], "seq")
    known = spread_join(known, seats.join(links, "_seat", "full"), ["_seat"], "seq")
    known = known.join(old_codes, "ticket_code", "left").withColumn("_room", F.col("_quota") - F.col("_sold"))

    no_seat = F.col("_seat").isNotNull() & F.col("_seat_known").isNull()
    faults = {
        "old_pair": F.col("_old_pair").isNotNull(),
        "linked": F.col("_linked").isNotNull(),
        "old_code": F.col("_old_code").isNotNull(),
        "category": F.col("_quota").isNull(),
        "order": F.col("_order").isNull(),
        "seat": no_seat,
    }
    # one column in place of eight, as all rows are dealt several times from here on
    bits = reduce(lambda a, b: a + b, [F.when(found, 1 << n).otherwise(0) for n, found in enumerate(faults.values())])
    known = known.select(*asked.columns, "_room", bits.alias("_faults"))
    fault = {name: F.col("_faults").bitwiseAND(1 << n) != 0 for n, name in enumerate(faults)}
    claims = {"pair": ["torder_id", "tcategory_id"], "seat": ["_seat"], "code": ["ticket_code"]}
    settled = settle(known, F.col("_faults") == 0, claims, ("tcategory_id", "_room"), component_rows)
    return judged(
        settled,
        [
            (fault["old_pair"] | F.col("_taken_pair"), "duplicate_ticket"),
            (fault["linked"] | F.col("_taken_seat"), "seat_taken"),
            (F.col("_full"), "quota_full"),
            (fault["old_code"] | F.col("_taken_code"), "duplicate_code"),
            (fault["category"], "unknown_category"),
            (fault["order"], "unknown_order"),
            (fault["seat"], "unknown_seat"),
        ],
    ).select(*cand.columns, "_seat", made.alias("ticket_id"), "ticket_code", "accepted", "reason")


def issue_tickets(t: Tables, cand: DataFrame, batch: str = "tickets") -> ChangeSet:
    """Adds the admitted tickets and their seats."""
    done = staged(judge_tickets(t, cand, batch), "tickets")
    admitted = done.filter("accepted")
    tickets = admitted.select("ticket_id", "ticket_code", "tcategory_id", "torder_id")
    if "status" in t["ticket"].columns:
        tickets = tickets.withColumn("status", F.lit(VALID))
    links = admitted.filter(F.col("_seat").isNotNull()).select(F.col("_seat").alias("seat_id"), "ticket_id")
    rewrites = {"ticket": _adding("ticket", tickets), "has_relationship": _adding("has_relationship", links)}
    return ChangeSet.of(t, rewrites, _refused(done, cand.columns), admitted.select("seq", "ticket_id", "ticket_code"))


def place_orders(t: Tables, priced: DataFrame, as_of, batch: str = "orders") -> ChangeSet:
    """Adds the orders of priced carts under the rules of the table: a total from zero up that fits its
    column, and a customer that is there."""
    customers = only_keys_of(t["customer"].select("customer_id"), priced, {"customer_id": "customer_id"})
    known = spread_join(priced, customers.withColumn("_customer", F.lit(True)), ["customer_id"], "cart_id")
    total = F.col("total_price").try_cast(_types(t, "order")["total_amount"])
    legal = judged(
        known.withColumnRenamed("reason", "_unpriced"),
        [
            (F.col("_unpriced").isNotNull(), "unpriced"),
            (F.col("total_price").isNotNull() & total.isNull(), "type"),
            (F.col("total_price") < 0, "check"),
            (F.col("customer_id").isNull() | F.col("total_price").isNull(), "null"),
            (F.col("_customer").isNull(), "reference:customer_id"),
        ],
    ).withColumn("reason", F.coalesce("_unpriced", "reason"))
    new = placed_orders(legal, as_of, batch).select(*t["order"].columns)
    ids = legal.filter("accepted").select("cart_id", stable_uuid(F.lit("order"), F.lit(batch), F.col("cart_id")).alias("order_id"))
    return ChangeSet.of(t, {"order": _adding("order", new)}, _refused(legal, ["cart_id"]), ids)


def update_order_status(t: Tables, changes: DataFrame) -> ChangeSet:
    """``changes``: order_id, payment_status."""
    return update_rows(t, "order", changes)


def normalise_promotions(df: DataFrame) -> DataFrame:
    """Codes in upper case; the words of the form become those of the table."""
    kind = F.col("discount_type")
    word = F.when(kind == "Persentase", "PERCENTAGE").when(kind == "Nominal", "NOMINAL").otherwise(kind)
    return df.withColumns({"promo_code": F.upper("promo_code"), "discount_type": word})


def register_users(t: Tables, regs: DataFrame, batch: str = "registrations") -> ChangeSet:
    """Splits registrations into account, role and profile.

    ``regs``: seq, role_name, username, password (hashed), full_name, phone_number, organizer_name,
    contact_email. A registration without its role or profile name is refused as a whole.
    """
    role = t["role"].select("role_id", "role_name")
    known = regs.join(role, "role_name", "left").withColumn(
        "user_id", stable_uuid(F.lit("user"), F.lit(batch), F.col("seq"))
    )
    nameless = ((F.col("role_name") == "customer") & F.col("full_name").isNull()) | (
        (F.col("role_name") == "organizer") & F.col("organizer_name").isNull()
    )
    profiles = [  # declared lengths and nulls of the rows that a registration makes
        ("user_account", F.lit(True)),
        ("customer", F.col("role_name") == "customer"),
        ("organizer", F.col("role_name") == "organizer"),
    ]
    too_long = reduce(
        lambda a, b: a | b,
        [made & F.coalesce(*length_violations(table, known.columns)).isNotNull() for table, made in profiles],
    )
    whole = judged(
        known, [(F.col("role_id").isNull(), "unknown_role"), (nameless, "missing_name"), (too_long, "length")]
    )
    whole = staged(whole, "registrations")
    named = staged(check_usernames(t["user_account"], whole.filter("accepted").drop("accepted", "reason")), "names")
    new = named.filter("accepted")

    def rows(table: str) -> Rewrite:
        source = new
        if table in ("customer", "organizer"):
            made = stable_uuid(F.lit(table), F.lit(batch), F.col("seq")).alias(f"{table}_id")
            source = source.filter(F.col("role_name") == table).select("*", made)
        return _adding(table, source.select(*t[table].columns))

    rewrites = {name: rows(name) for name in ("user_account", "account_role", "customer", "organizer")}
    refused = _refused(whole, ["seq", "username"]).unionByName(_refused(named, ["seq", "username"]))
    return ChangeSet.of(t, rewrites, refused, new.select("seq", "user_id"))


def update_profiles(t: Tables, changes: DataFrame) -> ChangeSet:
    """``changes``: user_id, name, phone_number, optionally contact_email and seq.

    A user with a customer profile changes that one, otherwise the organizer profile.
    """
    customers = t["customer"].select("user_id")
    extra = [c for c in ("seq",) if c in changes.columns]
    mail = [c for c in ("contact_email",) if c in changes.columns]
    mine = changes.join(customers, "user_id", "left_semi")
    others = changes.join(customers, "user_id", "left_anti")
    customer = update_rows(
        t, "customer", mine.select("user_id", F.col("name").alias("full_name"), "phone_number", *extra), ["user_id"]
    )
    organizer = update_rows(
        t, "organizer", others.select("user_id", F.col("name").alias("organizer_name"), *mail, *extra), ["user_id"]
    )
    return ChangeSet.of(t, {**customer.rewrites, **organizer.rewrites}, customer.rejects.unionByName(organizer.rejects))


def judge_events(t: Tables, changes: DataFrame, batch: str = "events") -> DataFrame:
    """Event forms with verdict. A form without ``event_id`` makes a new event."""
    first = F.min(F.struct("organizer_name", "organizer_id")).alias("first")
    default = t["organizer"].agg(first).select("first.organizer_id").scalar()

    new_id = stable_uuid(F.lit("event"), F.lit(batch), F.col("seq"))
    form = (
        changes.withColumn("_new", F.col("event_id").isNull())
        .withColumn("event_id", F.coalesce("event_id", new_id))
        .withColumn("title", strip(F.col("title")))
        .withColumn("event_datetime", event_moment(F.col("date"), F.col("time")))
        .withColumnRenamed("organizer_id", "_asked")
    )
    own = t["organizer"].select("user_id", F.col("organizer_id").alias("_own"))
    asked = t["organizer"].select(F.col("organizer_id").alias("_asked"), F.lit(True).alias("_asked_known"))
    old = t["event"].select("event_id", F.col("organizer_id").alias("_old_organizer"))
    venue = t["venue"].select("venue_id", F.lit(True).alias("_venue"))
    form = (
        form.join(own, "user_id", "left")
        .join(asked, "_asked", "left")
        .join(old, "event_id", "left")
        .join(venue, "venue_id", "left")
    )
    form = _with_category_flags(t, _with_artist_flags(t, form))

    admin = F.coalesce(F.col("role").isin("administrator", "admin"), F.lit(False))
    organizer = F.coalesce(F.col("role") == "organizer", F.lit(False))
    chosen = F.when(F.col("_asked").isNull(), default).when(F.col("_asked_known"), F.col("_asked"))
    chosen = F.when(organizer, F.col("_own")).otherwise(chosen)
    form = form.withColumn("organizer_id", F.when(F.col("_new"), chosen).otherwise(F.col("_old_organizer")))
    not_owner = ~F.col("_new") & organizer & ~F.coalesce(F.col("_own") == F.col("_old_organizer"), F.lit(False))
    return judged(
        form,
        [
            (~admin & ~organizer, "no_access"),
            (~F.col("_new") & F.col("_old_organizer").isNull(), "unknown_event"),
            (not_owner, "not_owner"),
            (blank(F.col("title")), "blank_title"),
            (F.col("event_datetime").isNull(), "bad_date"),
            (F.col("organizer_id").isNull(), "no_organizer"),
            (F.length("title") > 200, "length"),
            (F.col("_venue").isNull(), "unknown_venue"),
            (F.col("_bad_artists"), "bad_artists"),
            (F.col("_sold").isNotNull(), "sold_categories"),
            (F.col("_bad_categories"), "bad_categories"),
        ],
    )


def save_events(t: Tables, changes: DataFrame, batch: str = "events") -> ChangeSet:
    """Makes and changes events with their artists and categories, each form as a whole or not at all.

    ``changes``: seq, event_id, user_id, role, organizer_id, title, date, time, venue_id, artist_ids,
    names, prices, quotas. Of several good forms for one event the last one counts.
    """
    done = staged(judge_events(t, changes, batch), "events")
    used = ["event_id", "event_datetime", "title", "venue_id", "organizer_id", "_artists", "_lines", "seq"]
    last = _latest(done.filter("accepted").select(*used), ["event_id"])
    types = _types(t, "event")
    rows = last.select(
        "event_id", "event_datetime", F.col("title").alias("event_title"), "venue_id", "organizer_id"
    ).select(*[F.col(c).cast(types[c]).alias(c) for c in t["event"].columns])
    rewrites = {
        "event": _replacing(t, "event", "event_id", last.select("event_id"), rows),
        "event_artist": _artist_links(t, last),
        "ticket_category": _category_rows(t, last, batch),
    }
    return ChangeSet.of(t, rewrites, _refused(done, ["seq", "event_id"]), last.select("seq", "event_id"))
