"""Chat formatting after collapse of cumulative snapshots (operator 7), in DataFrame functions only.

Logs often hold a conversation once per turn, each time a little longer. A conversation goes if another
begins with all its turns and goes on; of equal ones the smallest conv_id stays. Every prefix of a
conversation has a rolling hash (128 bits: the turns' hashes, which include their position, joined by
exclusive or). A conversation goes just if more conversations have its hash as that of a prefix than as that of the whole,
so equal prefixes are counted, without texts and before they are joined, and common openings do no harm.

A conversation may have very many turns. Their positions come from ranges, the rolling hashes from blocks of turns and
the totals of the blocks before, and texts are gathered, block by block, only of the conversations that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.llm.staging import staged
from boxoffice.operators.ranges import positions
from boxoffice.operators.spread import spread_join

BLOCK_BITS = 12  # turns of a block

BEGIN, END = "<|im_start|>", "<|im_end|>"


def turn_hash(salt: int) -> Column:
    known = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(F.lit(salt), F.col("at"), *known)


def rendered(turn: Column) -> Column:
    """A turn between markers; a marker's first characters are set apart within role and text."""
    plain = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(BEGIN), plain(turn["role"]), F.lit("\n"), plain(turn["text"]), F.lit(END + "\n"))


def formatted(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text, ..)`` -> ``(conv_id, n_turns, n_equal, text)`` of those that stay.

    Turns are in the order of turn, role and text (nulls first); equal rows of a conversation count once.
    ``n_equal`` is the number of conversations with the same turns, this one included. Null roles and
    texts render as empty but are not equal to empty ones. Rows without conv_id belong to no conversation
    and are left out; other columns are ignored; no rows give no rows.
    """
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [F.asc("turn"), F.asc("role"), F.asc("text")]
    placed = positions(rows.distinct(), ["conv_id"], order).withColumn("at", F.col("position") - 1).drop("position", "turn")
    turns = staged(placed.withColumn("block", F.shiftright("at", BLOCK_BITS)), "turns")
    hashed = turns.select("conv_id", "block", "at", turn_hash(1).alias("a"), turn_hash(2).alias("b"))

    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), zero).alias(f"{c}_before") for c in "ab"])
    within = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rolling = hashed.select("conv_id", "block", (F.col("at") + 1).alias("k"), *[F.bit_xor(c).over(within).alias(c) for c in "ab"])
    rolling = rolling.join(offsets, ["conv_id", "block"])
    key = ["k", "a", "b"]
    prefixes = rolling.select("k", *[F.col(c).bitwiseXOR(F.col(f"{c}_before")).alias(c) for c in "ab"]).groupBy(*key).agg(F.count("*").alias("n_begun"))
    whole = totals.groupBy("conv_id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("k"))
    whole = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    kept = staged(whole.join(prefixes, key).filter("n_begun = n_equal").select("conv_id", F.col("k").alias("n_turns"), "n_equal"), "conversations")

    said = spread_join(turns, kept.select("conv_id"), ["conv_id"], "at", "left_semi")
    lines = lambda part: F.array_join(F.transform(F.array_sort(part), rendered), "")
    parts = said.groupBy("conv_id", "block").agg(lines(F.collect_list(F.struct("at", "role", "text"))).alias("part"))
    texts = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    text = F.array_join(F.col("parts.part"), "")
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_equal", text.alias("text"))
