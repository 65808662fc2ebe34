"""Chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation again after every turn.  Each turn's
position gives a rolling hash of the conversation up to it; a conversation
whose whole hash is some other conversation's shorter prefix is a snapshot and
is dropped by an anti-join, and of equal conversations the least id stays.  The
rest is rendered, at most ``PART`` turns to a row.

DataFrame functions only.  Positions come from a global index over a range
partitioning, so a conversation with most of all turns, or one turn repeated in
most rows, is spread (``turns`` are read from files, so that a task run again
numbers its rows alike).  The rolling hash is a running xor of two 64-bit hashes
of (position, role, text), over blocks of ``PART`` positions, then over the blocks:
128 bits, so that two unlike prefixes agree with a probability of about 3e-39.  Both sides of the anti-join are
aggregated to one row per hash first, so a first turn that every conversation
shares is one row.

Defined cases: null role or text is empty in the output but differs from an
empty one; turns are ordered by ``turn`` (null last), ties by hash of role and
text; a repeated row is a repeated turn; a null conversation id is one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dense_index

PART = 256


def _told(c: str) -> Column:
    """The value, with null told from empty."""
    return F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))


def _mix(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "p", "h1", "h2")


def positions(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, role, text, h1, h2, p``: position from 1 in each conversation."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                        F.col(text).alias("text"), F.xxhash64(_told(role), _told(text)).alias("h1"),
                        F.xxhash64(F.lit(7), _told(text), _told(role)).alias("h2"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("h1").asc(), F.col("h2").asc()]
    idx = dense_index(rows, order, "g", spread_ties=True)
    first = idx.groupBy("conv").agg(F.min("g").alias("g0"), F.count(F.lit(1)).alias("n"))
    first = cut(first.withColumnRenamed("conv", "c"))
    return idx.join(first, idx["conv"].eqNullSafe(first["c"])).select(
        "conv", "role", "text", "h1", "h2", "n", (F.col("g") - F.col("g0") + 1).alias("p"))


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """``conv, n, p, a, b``: rolling hash pair of each conversation up to ``p``."""
    rows = placed.select("conv", "n", "p", F.floor((F.col("p") - 1) / F.lit(PART)).alias("part"),
                         _mix(1).alias("x"), _mix(2).alias("y"))
    sums = rows.groupBy("conv", "part").agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("c"), F.col("part").alias("k"),
                       F.coalesce(F.bit_xor("sx").over(before), F.lit(0)).alias("bx"),
                       F.coalesce(F.bit_xor("sy").over(before), F.lit(0)).alias("by"))
    own = Window.partitionBy("conv", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("x", F.bit_xor("x").over(own)).withColumn("y", F.bit_xor("y").over(own))
    j = rows.join(sums, rows["conv"].eqNullSafe(sums["c"]) & (rows["part"] == sums["k"]))
    return j.select("conv", "n", "p", F.col("x").bitwiseXOR(F.col("bx")).alias("a"),
                    F.col("y").bitwiseXOR(F.col("by")).alias("b"))


def maximal_conversations(placed: DataFrame) -> DataFrame:
    """``conv`` of the conversations that no other one continues."""
    hashes = cut(prefix_hashes(placed))
    whole = hashes.filter("p = n").groupBy("p", "a", "b").agg(F.min(F.struct("conv"))["conv"].alias("conv"))
    longer = hashes.filter("p < n").select("p", "a", "b").distinct()
    return whole.join(longer, ["p", "a", "b"], "left_anti").select("conv")


def render_turn() -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"),
                    F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))


def collapse_and_render(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text") -> DataFrame:
    """``conv, part, n_turns, rendered`` of every maximal conversation."""
    placed = cut(positions(turns, conv, turn, role, text))
    kept = cut(maximal_conversations(placed)).withColumnRenamed("conv", "c")
    rows = placed.join(kept, placed["conv"].eqNullSafe(kept["c"]), "left_semi").select(
        "conv", "p", F.floor((F.col("p") - 1) / F.lit(PART)).cast("int").alias("part"), render_turn().alias("piece"))
    parts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n_turns"),
                                             F.array_sort(F.collect_list(F.struct("p", "piece"))).alias("pieces"))
    return parts.select(F.col("conv").alias(conv), "part", "n_turns",
                        F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("rendered"))
