"""Unique values that rows take and give up in the same batch.

A row with an id that moves to another value frees the one it had for the rows after it, so whether a row
gets its value may hang on the rows before it. Most values are given up by nobody; for them the earliest
claim decides (`held`). Only rows that have to do with a value that may be given up are settled in order.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.operators.conflicts import COMPONENT_ROWS, components, in_order
from boxoffice.operators.spread import only_keys_of, spread_join, without_keys_of
from boxoffice.session import drop_staged, shared_dir, staged


def _all_set(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _yes(col: Column) -> Column:
    return F.coalesce(col, F.lit(False))


def held(cand: DataFrame, existing: DataFrame, keys: list[str], id_column: str, eligible: Column) -> DataFrame:
    """Adds ``_taken`` and ``existing_id``: another row, old or earlier in the batch, has the same key.

    Nobody gives up a key here. Per key the smallest and largest id among the old rows are enough to tell
    whether one of them is not the candidate itself. A candidate without id is distinct from all others.
    Where a key has old rows, all candidates but their owner fail on those, so the earliest candidate
    matters only for keys that are new; both facts are aggregates on the key and meet before the one join
    to the candidates.
    """
    old = only_keys_of(existing, cand, {k: k for k in keys})
    old = old.groupBy(*keys).agg(F.min(id_column).alias("_low"), F.max(id_column).alias("_high"))
    claim = F.when(eligible, F.col("seq"))
    asked = cand.filter(_all_set(keys)).groupBy(*keys)
    asked = asked.agg(F.min(claim).alias("_first"), F.min_by(id_column, claim).alias("_first_id"))
    facts = asked.join(old, keys, "left")

    own, low, high = F.col(id_column), F.col("_low"), F.col("_high")
    other = F.when(own.isNull() | (low != own), low).when(high != own, high)
    distinct = own.isNull() | F.col("_first_id").isNull() | (F.col("_first_id") != own)
    beaten = low.isNull() & _yes((F.col("_first") < F.col("seq")) & distinct)
    return (
        spread_join(cand, facts, keys, "seq")
        .withColumn("_taken", other.isNotNull() | beaten)
        .withColumn("existing_id", F.coalesce(other, F.when(beaten, F.col("_first_id"))))
        .drop("_low", "_high", "_first", "_first_id")
    )


def moved(
    cand: DataFrame,
    existing: DataFrame,
    keys: list[str],
    id_column: str,
    eligible: Column,
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """`held`, as if the candidates came one by one in order of ``seq`` and each one that is eligible and
    gets its key (a NULL in it claims nothing) gave up what its id had before.

    Rows that are not eligible hold and give up nothing. If no row gives up anything, which is looked up first,
    `held` is the answer. Otherwise the rows that need an order are linked by the keys and ids that they have
    in common. Components of at most ``component_rows`` rows are settled in one ordered pass each, in tasks of
    their own; larger ones in rounds over written tables, one for each link of the longest chain.
    """
    slim = cand.select("seq", *keys, F.col(id_column).alias("_id"), _yes(eligible).alias("_eligible"))
    slim = slim.withColumn("_key", F.when(_all_set(keys), F.struct(*keys)))
    old = existing.select(*keys, F.col(id_column).alias("_id"))
    kept = old.filter(_all_set(keys)).select(F.struct(*keys).alias("_key"), "_id")
    if not _gives_up(slim, kept):
        return held(cand, existing, keys, id_column, eligible)
    verdicts = staged(held(slim, old, keys, "_id", F.col("_eligible")), "held")
    open_rows, ties, holdings = _in_order(verdicts, kept)
    decided = _settled(open_rows, ties, holdings, component_rows)
    facts = verdicts.select("seq", "_taken", "existing_id").join(
        decided.select("seq", F.col("taken").alias("_moved_taken"), F.col("holder").alias("_holder")), "seq", "left"
    )
    known = F.col("_moved_taken").isNotNull()
    facts = facts.select(
        "seq",
        F.when(known, F.col("_moved_taken")).otherwise(F.col("_taken")).alias("_taken"),
        F.when(known, F.col("_holder")).otherwise(F.col("existing_id")).alias("existing_id"),
    )
    return cand.join(facts, "seq")


def _wanted(claims: DataFrame) -> DataFrame:
    return claims.groupBy("_id").agg(F.min("_key").alias("_low"), F.max("_key").alias("_high"), F.max(F.col("_key").isNull()).alias("_none"))


def _gives_up(rows: DataFrame, old: DataFrame) -> bool:
    """Some id that may move has or claims a key and a row for another one, or for none."""
    claims = rows.filter("_eligible AND _id IS NOT NULL").select("_id", "_key")
    wanted = _wanted(claims)
    between = wanted.filter("_low <> _high OR (_none AND _low IS NOT NULL)")
    leaving = spread_join(old, wanted, ["_id"], how="inner").filter("_none OR _low <> _key OR _high <> _key")
    return not between.select("_id").unionByName(leaving.select("_id")).isEmpty()


def _in_order(rows: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that need an order: ``(seq, key, id, eligible, gets)``, ``gets`` known for rows whose key is
    certain; the ``ties`` (key, id) by which an id may give up a key; and the old ``holdings`` (key, id)."""
    claims = rows.filter("_eligible AND _id IS NOT NULL").select("seq", "_key", "_id")
    own = only_keys_of(old, claims, {"_id": "_id"})
    # an id gives up a key that it holds or claims only with a row for another one
    ties = own.unionByName(claims.filter("_key IS NOT NULL").select("_key", "_id")).distinct()
    ties = spread_join(ties, _wanted(claims), ["_id"], how="inner").filter("_none OR _low <> _key OR _high <> _key").select("_key", "_id")
    # a key with an old holder that is no candidate is never free
    ids = claims.select("_id").distinct()
    fixed = without_keys_of(only_keys_of(old, rows, {"_key": "_key"}), ids, ["_id"]).select("_key").distinct()
    ties = without_keys_of(only_keys_of(ties, rows, {"_key": "_key"}), fixed, ["_key"])
    ties = staged(ties, "ties")
    loose = ties.select("_key").distinct().withColumn("_loose", F.lit(True))
    movers = ties.select("_id").distinct().withColumn("_mover", F.lit(True))
    seen = spread_join(rows, loose, ["_key"], "seq")
    seen = spread_join(seen, movers, ["_id"], "seq")
    gets = F.when(F.col("_loose").isNull(), ~F.col("_taken"))
    open_rows = seen.filter("_loose OR (_mover AND _eligible)").select("seq", "_key", "_id", "_eligible", gets.alias("_gets"))
    holdings = own.join(ties.select("_key").distinct(), "_key", "left_semi")
    return open_rows.filter("_gets IS NULL OR _gets"), ties, holdings.select("_key", "_id")


def _settled(open_rows: DataFrame, ties: DataFrame, holdings: DataFrame, component_rows: int) -> DataFrame:
    """``(seq, taken, holder)`` of the open rows whose key is not certain."""
    spark = open_rows.sparkSession
    rows, holdings = staged(open_rows, "open"), staged(holdings, "holdings")
    kinds = f"seq {rows.schema['seq'].dataType.simpleString()}, taken boolean, holder {rows.schema['_id'].dataType.simpleString()}"
    # keys and ids go by the first open row that has to do with them
    of_key = rows.filter("_gets IS NULL").groupBy("_key").agg(F.min("seq").alias("_k"))
    of_id = rows.filter("_eligible AND _id IS NOT NULL").groupBy("_id").agg(F.min("seq").alias("_o"))
    named = spread_join(spread_join(rows, of_key, ["_key"], "seq"), of_id, ["_id"], "seq")
    named = staged(named.withColumn("_o", F.when(F.col("_eligible"), F.col("_o"))), "named")
    kept = staged(spread_join(spread_join(holdings, of_key, ["_key"], "_id", "inner"), of_id, ["_id"], "_key"), "kept")
    links = named.select(F.col("seq").alias("u"), F.col("_k").alias("v")).unionByName(named.select("seq", "_o").toDF("u", "v"))
    labels = components(links.unionByName(kept.select("_k", "_o").toDF("u", "v")))
    labels = staged(labels, "labels")
    placed = staged(_labelled(named, labels, "seq"), "components")
    large = staged(placed.groupBy("component").agg(F.count("*").alias("_size")).filter(F.col("_size") > component_rows).select("component"), "large")

    walk = ["component", "_turn", "seq", "_k", "_id", "_eligible", "_gets"]
    before = _labelled(kept, labels, "_k").selectExpr("component", "0 AS _turn", f"cast(NULL AS {rows.schema['seq'].dataType.simpleString()}) AS seq", "_k", "_id", "true AS _eligible", "cast(NULL AS boolean) AS _gets")
    turns = placed.withColumn("_turn", F.lit(1)).select(*walk).unionByName(before.select(*walk))
    folder = f"{shared_dir(spark).rstrip('/')}/boxoffice/decided-{uuid.uuid4().hex}"
    in_order(without_keys_of(turns, large, ["component"]), ["_turn", "seq"], kinds, _walk).write.parquet(f"{folder}/step=0")
    if not large.isEmpty():
        waiting = spread_join(placed, large, ["component"], "seq", "left_semi").select(*open_rows.columns)
        _in_rounds(waiting, ties, holdings, folder)
    return spark.read.schema(f"{kinds}, step int").parquet(folder).drop("step")


def _labelled(rows: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    found = spread_join(rows.withColumn("id", F.col(by)), labels, ["id"], by)
    return found.withColumn("component", F.coalesce("component", "id")).drop("id")


def _walk():
    """One component: first what its ids hold, then its rows in order."""
    holders: dict = {}
    of_id: dict = {}

    def step(row: tuple) -> tuple | None:
        _, turn, seq, key, who, eligible, gets = row
        who = who if who is not None else object()
        result, others = None, set()
        if turn and key is not None and gets is None:
            others = holders.get(key, set()) - {who}
            named = [o for o in others if type(o) is not object]
            result = (seq, bool(others), min(named) if named else None)
        if others or not eligible:
            return result
        if turn:
            for given_up in of_id.pop(who, set()):
                holders[given_up].discard(who)
        if key is not None:
            holders.setdefault(key, set()).add(who)
            of_id.setdefault(who, set()).add(key)
        return result

    return step


def _in_rounds(rows: DataFrame, ties: DataFrame, holdings: DataFrame, folder: str) -> None:
    """The same for components of any size; every round adds what it decides to the folder."""
    still, holding = staged(rows, "open"), staged(holdings, "holdings")
    step = 1
    while not still.isEmpty():
        marked = staged(_round(still, ties, holding), "marked")
        done = marked.filter("_done")
        decided = done.filter("_gets IS NULL").select("seq", F.col("_other").alias("taken"), F.when(F.col("_other"), F.col("_holder")).alias("holder"))
        decided.write.parquet(f"{folder}/step={step}")
        placed = done.filter("_eligible AND NOT _other")
        kept = without_keys_of(holding, placed.filter("_id IS NOT NULL"), ["_id"])
        loose = ties.select("_key").distinct()
        after = staged(kept.unionByName(placed.join(loose, "_key", "left_semi").select("_key", "_id")), "holdings")
        drop_staged(holding)
        drop_staged(still)
        still, holding = staged(marked.filter("NOT _done").select(*rows.columns), "open"), after
        drop_staged(marked)
        step += 1


def _round(rows: DataFrame, ties: DataFrame, holding: DataFrame) -> DataFrame:
    """Adds ``_done``, ``_other`` (another one holds the key) and ``_holder``.

    Before the first open row that may give up a key, all claims of others on a held key fail at once, and
    on a free key the earliest claim is decided. Rows of one id that get something do so in their order. The
    earliest open row of all is always decided.
    """
    # of each id the next row, and the next that wants another key than that one
    gives = rows.filter("_eligible AND _id IS NOT NULL")
    next_row = gives.groupBy("_id").agg(F.min(F.struct("seq", "_key")).alias("_next"))
    another = F.min(F.when(~F.col("_key").eqNullSafe(F.col("_next._key")), F.col("seq"))).alias("_another")
    next_rows = spread_join(gives, next_row, ["_id"], "seq").groupBy("_id").agg(F.min("_next").alias("_next"), another)
    gives_up = F.when(F.col("_next._key").eqNullSafe(F.col("_key")), F.col("_another")).otherwise(F.col("_next.seq"))
    freed = spread_join(ties, next_rows, ["_id"], how="inner").groupBy("_key").agg(F.min(gives_up).alias("_freed"))
    first = rows.filter("_gets IS NULL").groupBy("_key").agg(F.min("seq").alias("_first"))
    held_by = holding.groupBy("_key").agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), F.max(F.col("_id").isNull()).alias("_new"))
    facts = first.join(freed, "_key", "left").join(held_by, "_key", "left")
    # nobody gives up a key before the claims that come earlier are decided
    waiting = spread_join(ties, first, ["_key"], "_id").groupBy("_id").agg(F.min("_first").alias("_waiting"))
    turns = gives.groupBy("_id").agg(F.min("seq").alias("_turn")).join(waiting, "_id", "left")
    seen = spread_join(spread_join(rows, facts, ["_key"], "seq"), turns, ["_id"], "seq")
    unsure = F.col("_gets").isNull()
    own = F.col("_id")
    other = unsure & _yes(F.col("_new") | (F.col("_low").isNotNull() & (own.isNull() | (F.col("_low") != own) | (F.col("_high") != own))))
    holder = F.when(own.isNull() | (F.col("_low") != own), F.col("_low")).when(F.col("_high") != own, F.col("_high"))
    in_time = F.col("_freed").isNull() | (F.col("seq") < F.col("_freed"))
    next_of_id = (F.col("seq") == F.col("_turn")) & (F.col("_waiting").isNull() | (F.col("seq") <= F.col("_waiting")))
    my_turn = ~F.col("_eligible") | own.isNull() | next_of_id
    sure = ~unsure & my_turn
    done = sure | (unsure & in_time & (other | ((F.col("seq") == F.col("_first")) & my_turn)))
    return seen.select(*rows.columns, _yes(done).alias("_done"), other.alias("_other"), holder.alias("_holder"))
