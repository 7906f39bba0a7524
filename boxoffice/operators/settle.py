"""Who gets in when rows compete for several things at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from boxoffice.operators.conflicts import COMPONENT_ROWS
from boxoffice.operators.spread import running_counts, spread_join, without_keys_of
from boxoffice.session import drop_staged, shared_dir, staged

# Open rows that one task walks through before the next ones are looked at.
BLOCK_ROWS = 1_000_000
# Rows of a block that are Python objects at a time.
STEP_ROWS = 1 << 16
NO_LIMIT = 1 << 62
# What a row that a block reads is: an open row, a value held before the block, or a value that a later block needs.
OPEN, HELD, AHEAD = range(3)


def settle(
    cand: DataFrame,
    eligible: Column,
    claims: Mapping[str, Sequence[str]],
    room: tuple[str, str] | None = None,
    component_rows: int = COMPONENT_ROWS,
) -> DataFrame:
    """Decides candidates in order of ``seq`` as if they came one by one.

    A row gets in if no earlier admitted row has the same value of a claim (a set of columns; a NULL in
    it claims nothing), and if fewer than ``room`` earlier rows of its group got in. ``room`` names the
    group column and the column with the places left (NULL: no limit). Rows that are not eligible stay
    out and hold nothing.

    Adds ``_in``, one ``_taken_<claim>`` per claim and ``_full``: what stood in the way of each row,
    eligible or not, when its turn came.

    One claim without room is the earliest row per value. Otherwise the values that several rows claim are named once
    by their first row, and all that follows goes by these names. First a row gets in if no open row before it could
    stand in its way, and every open row that this beats goes out. The rest are walked through in order of ``seq``,
    in one task if they are at most ``component_rows``, else in blocks of about ``BLOCK_ROWS`` rows, one after the
    other; a block is told what is held of its values.
    """
    judged = cand.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    if len(claims) == 1 and not room:
        values = {name: f"_k_{name}" for name in claims}
        keyed = judged.withColumns({values[name]: _key(columns) for name, columns in claims.items()})
        out = _with_in(keyed, _one_claim(keyed.filter("_eligible"), *values.values()))
    else:
        written = staged(judged, "candidates")
        named = staged(_named(written, list(claims.values())), "named")
        drop_staged(written)
        values = {name: f"_v{n}" for n, name in enumerate(claims)}
        limits = [F.lit(None).cast("string").alias("_group"), F.lit(None).cast("long").alias("_room")]
        if room:
            limits = [F.col(room[0]).alias("_group"), F.col(room[1]).cast("long").alias("_room")]
        firsts = [f"_first{n}" for n in range(len(claims))]
        rows = named.filter("_eligible").select("seq", *values.values(), *firsts, *limits, F.lit(0).cast("long").alias("_in_before"))
        admitted = _admitted(rows, len(claims), bool(room), component_rows)
        out = staged(_with_in(named.drop(*firsts, "_eligible"), admitted), "settled")

    inside, full = out.filter("_in"), F.lit(False)
    if room:
        out = running_counts(out, [room[0]], {"_before": F.col("_in")})
        full = F.coalesce(F.col("_before") >= F.col(room[1]), F.lit(False))
    for name, value in values.items():
        holders = inside.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_at")).agg(F.min("seq").alias("_holder"))
        taken = F.coalesce(F.col("_holder") < F.col("seq"), F.lit(False))
        out = spread_join(_at(out, value), holders, ["_at"], "seq").withColumn(f"_taken_{name}", taken).drop("_holder", "_at")
    return out.withColumn("_full", full).drop(*values.values(), "_before", "_eligible")


def _key(columns: Sequence[str]) -> Column:
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(whole, F.struct(*columns))


def _at(rows: DataFrame, value: str) -> DataFrame:
    """Adds ``_at``, the value to join by. A row whose value has no name, or that claims none, goes by its own ``seq``,
    which names no value of another row, so that such rows do not meet in one task."""
    return rows.withColumn("_at", F.coalesce(value, "seq") if value.startswith("_v") else F.col(value))


def _with_in(rows: DataFrame, admitted: DataFrame) -> DataFrame:
    out = rows.join(admitted.select("seq", F.lit(True).alias("_in")), "seq", "left")
    return out.withColumn("_in", F.coalesce("_in", F.lit(False)))


def _one_claim(rows: DataFrame, key: str) -> DataFrame:
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("seq"))
    return first.select("seq").unionByName(rows.filter(F.col(key).isNull()).select("seq"))


def _named(rows: DataFrame, claims: Sequence[Sequence[str]]) -> DataFrame:
    """Adds ``_v0, ..``: the first row that claims the same, which names the value exactly, and ``_first0, ..``: the
    first eligible one. NULL for a value that no other row claims."""
    out = rows
    for n, columns in enumerate(claims):
        first = F.min(F.when(F.col("_eligible"), F.col("seq"))).alias(f"_first{n}")
        claimed = rows.withColumn("_k", _key(columns)).filter("_k IS NOT NULL").groupBy("_k")
        claimed = claimed.agg(F.count("*").alias("_rows"), F.min("seq").alias(f"_v{n}"), first).filter("_rows > 1").drop("_rows")
        out = spread_join(out.withColumn("_k", _key(columns)), claimed, ["_k"], "seq").drop("_k")
    return out


def _admitted(rows: DataFrame, claims: int, limited: bool, component_rows: int) -> DataFrame:
    """``seq`` of the rows that get in."""
    marked = staged(_marked(rows, claims, limited), "marked")
    still = staged(_not_beaten(marked, claims, limited), "open")
    sure = marked.filter("_new").select("seq")
    if not (many := still.count()):
        return sure
    blocks = 1 if many <= component_rows else -(-many // BLOCK_ROWS)
    return sure.unionByName(_in_blocks(_grouped(still, limited), claims, blocks))


def _marked(rows: DataFrame, claims: int, limited: bool) -> DataFrame:
    """Adds ``_new``: no open row before this one could stand in its way."""
    clear, seen = F.lit(True), rows
    if limited:
        seen = running_counts(seen, ["_group"], {"_open_before": F.lit(True)})
        clear = F.col("_room").isNull() | (F.col("_in_before") + F.col("_open_before") < F.col("_room"))
    firsts = [f"_first{n}" for n in range(claims)]
    for first in firsts:
        clear = clear & (F.col(first).isNull() | (F.col(first) == F.col("seq")))
    return seen.withColumn("_new", clear).select(*[c for c in rows.columns if c not in firsts], "_new")


def _not_beaten(marked: DataFrame, claims: int, limited: bool) -> DataFrame:
    """The rows that are open after the new ones got in."""
    left = marked
    if limited:
        left = running_counts(left, ["_group"], {"_new_before": F.col("_new")})
        left = left.withColumn("_in_before", F.col("_in_before") + F.col("_new_before")).drop("_new_before")
        left = left.filter(F.col("_room").isNull() | (F.col("_in_before") < F.col("_room")))
    left = left.filter("NOT _new").drop("_new")
    for value in [f"_v{n}" for n in range(claims)]:
        gone = marked.filter(F.col("_new") & F.col(value).isNotNull()).select(F.col(value).alias("_at"))
        left = without_keys_of(_at(left, value), gone, ["_at"]).drop("_at")
    return left


def _grouped(rows: DataFrame, limited: bool) -> DataFrame:
    """Adds ``_g``: the group by its first open row; NULL for a group that its open rows cannot fill."""
    if not limited:
        return rows.withColumn("_g", F.lit(None).cast(rows.schema["seq"].dataType)).drop("_group")
    limit = rows.filter("_room IS NOT NULL").groupBy("_group")
    # in the order of seq the rows before a row are at most those already in and all open ones
    limit = limit.agg(F.min("seq").alias("_g"), (F.max("_in_before") + F.count("*")).alias("_most"), F.max("_room").alias("_places"))
    out = spread_join(rows, limit.filter("_most > _places").select("_group", "_g"), ["_group"], "seq")
    return out.withColumn("_g", F.when(F.col("_room").isNotNull(), F.col("_g"))).drop("_group")


def _in_blocks(rows: DataFrame, claims: int, blocks: int) -> DataFrame:
    """``seq`` of the rows that get in, settled in blocks by order of ``seq``.

    What is held of a value or group goes on to the next block in which it occurs. So a block reads its own rows and
    what is held of their values, and neither a task nor the driver keeps anything from one block to the next.
    """
    spark, seq, names = rows.sparkSession, rows.schema["seq"].dataType.simpleString(), [*[f"_v{n}" for n in range(claims)], "_g"]
    folder = f"{shared_dir(spark).rstrip('/')}/boxoffice/blocks-{uuid.uuid4().hex}"

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.partitionBy("block").parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    dealt = kept(rows.repartitionByRange(blocks, "seq").withColumn("block", F.spark_partition_id()), "rows")
    if blocks > 1:
        values = dealt.select("block", F.posexplode(F.array(*names)).alias("kind", "value")).filter("value IS NOT NULL").distinct()
        following = F.lead("block").over(Window.partitionBy("kind", "value").orderBy("block"))
        ahead = kept(values.withColumn("at", following).filter("at IS NOT NULL"), "ahead")
    # seq of the rows that get in (at -1), and what is held of the values that the block ``at`` needs
    told = f"seq {seq}, kind int, value {seq}, taken long, at int"
    spark.createDataFrame([], told).write.parquet(f"{folder}/told")
    for block in range(blocks):
        now = dealt.filter(F.col("block") == block).drop("block").withColumn("_what", F.lit(OPEN))
        if blocks > 1:
            held = spark.read.schema(told).parquet(f"{folder}/told").filter(F.col("at") == block).drop("seq", "at")
            needed = ahead.filter(F.col("block") == block).drop("block")
            for rows_of, what in ((held, HELD), (needed, AHEAD)):
                now = now.unionByName(rows_of.withColumn("_what", F.lit(what)), allowMissingColumns=True)
        walked = now.coalesce(1).mapInArrow(_walk(names, blocks > 1, told), told)
        walked.write.mode("append").partitionBy("at").parquet(f"{folder}/told")
    return spark.read.schema(told).parquet(f"{folder}/told").filter("at = -1").select("seq")


def _walk(names: Sequence[str], onward: bool, told: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One task with a block: its open rows in order of ``seq``. Values are numbers of places in arrays, so that a row
    costs few microseconds and the block few hundred bytes per row."""
    schema = to_arrow_schema(StructType.fromDDL(told))

    def result(**columns) -> pa.Table:
        given = {name: column if isinstance(column, pa.Array) else pa.array(column) for name, column in columns.items()}
        size = len(next(iter(given.values())))
        return pa.table([given[f.name].cast(f.type) if f.name in given else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, told_rows = [], []
        for batch in batches:  # only what is used of a batch stays
            is_open = pc.equal(batch["_what"], OPEN)
            read.append(batch.select(["seq", "_room", "_in_before", *names]).filter(is_open))
            if onward:
                told_rows.append(batch.select(["_what", "kind", "value", "taken", "at"]).filter(pc.invert(is_open)))
        if not read:
            return
        rows = pa.Table.from_batches(read)
        del read
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("seq", "ascending")], null_placement="at_start"))
        others = pa.Table.from_batches(told_rows) if onward else None
        del told_rows
        many = rows.num_rows
        held, own, told_of = bytearray(), [], []
        for kind, name in enumerate(names):
            of_kind = others.filter(pc.equal(others["kind"], kind)) if onward else None
            asked = of_kind["value"].chunks if onward else []
            codes = pa.chunked_array([*rows[name].chunks, *asked], rows[name].type).combine_chunks().dictionary_encode()
            size = len(codes.dictionary)
            places = codes.indices.fill_null(size).to_numpy()
            del codes
            mine, before = places[:many], places[many:]
            what = of_kind["_what"].to_numpy() if onward else np.zeros(0, np.int32)
            if kind == len(names) - 1:
                group, taken = mine, np.zeros(size + 1, np.int64)
                if onward:
                    np.add.at(taken, before[what == HELD], of_kind["taken"].to_numpy()[what == HELD].astype(np.int64))
                inside = taken.tolist()
                offset = 0
            else:
                offset = len(held)
                # a row that claims nothing has a place of its own
                claimed = np.zeros(size + many, np.uint8)
                claimed[before[what == HELD]] = 1
                held += claimed.tobytes()
                if size:
                    own.append(np.where(mine == size, size + np.arange(many), mine) + offset)
            told_of.append((of_kind, what, before, offset))
        left = pc.fill_null(pc.subtract(rows["_room"], rows["_in_before"]), NO_LIMIT).to_numpy()
        left = np.where(group == len(inside) - 1, NO_LIMIT, left)

        chosen = []
        for start in range(0, many, STEP_ROWS):
            step = slice(start, start + STEP_ROWS)
            of_row = zip(*(places[step].tolist() for places in own)) if own else ((),) * len(left[step])
            for at, most, g, mine in zip(range(start, many), left[step].tolist(), group[step].tolist(), of_row):
                if inside[g] >= most:
                    continue
                for place in mine:
                    if held[place]:
                        break
                else:
                    for place in mine:
                        held[place] = 1
                    inside[g] += 1
                    chosen.append(at)
        yield from result(seq=rows["seq"].take(pa.array(chosen, pa.int64())).combine_chunks(), at=np.full(len(chosen), -1)).to_batches()

        for kind, (of_kind, what, before, offset) in enumerate(told_of if onward else ()):
            now = np.array(inside) if kind == len(names) - 1 else np.frombuffer(held, np.uint8)[offset:]
            goes = np.flatnonzero((what == AHEAD) & (now[before] > 0))
            value, at = (of_kind[name].combine_chunks().take(pa.array(goes)) for name in ("value", "at"))
            yield from result(kind=np.full(len(goes), kind), value=value, taken=now[before[goes]], at=at).to_batches()

    return run
