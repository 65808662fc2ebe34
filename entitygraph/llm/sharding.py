"""Sharding by histogram sort: equal bytes per shard along a sort key.

Law: ``bytes``.  A compact table of (key, tie, size) is written once.  For
every inner shard boundary the exact number of bytes below candidate keys is
counted, all boundaries and all partitions at once, and the candidates are
refined: each unsettled boundary's key bracket is cut into ``PROBES`` equal
parts, rows are counted into (bracket, part) cells by a partial aggregate, and
the part that holds the wanted byte position becomes the next bracket.  A
boundary is settled when a candidate lies within ``tolerance`` of a mean shard
or its bracket is a single key; a single key heavier than that (rows repeating
one id) is refined further on ``tie``, a row number fixed by the written table.
Then the rows are exchanged once, on (shard, salt), which also numbers them.

DataFrame functions only; the driver holds one row per (open bracket, part):
at most ``39 * PROBES`` at 40 shards, whatever the input.

Defined cases: null text has size ``ROW_BYTES`` and crc32 of no bytes (0); a
null key sorts first; repeated rows are separate rows; an empty table gives
an empty result; shards may be empty when there are fewer rows than shards;
other columns are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARDS = 40
ROW_BYTES = 16
PROBES = 256
#: Allowed distance of a boundary from its place, as a share of a mean shard.
TOLERANCE = 0.002
LOWEST = -(1 << 63)
HIGHEST = (1 << 63) - 1


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long")


def _cells(rows: DataFrame, value: str, brackets: list[tuple[int, int, int]]) -> dict[int, list[int]]:
    """Bytes in each of the equal parts of each bracket ``(lo, hi, step)``
    (both ends included; brackets are disjoint)."""
    cell = F.lit(None).cast("long")
    for i, (lo, hi, step) in enumerate(brackets):
        inside = (F.col(value) >= lo) & (F.col(value) <= hi)
        if hi - lo < 1 << 62:
            part = F.expr(f"({value} - ({lo}L)) div {step}L")
        else:  # the difference may not fit a long
            part = F.expr(f"(cast({value} as decimal(20,0)) - ({lo}BD)) div {step}BD")
        cell = F.when(inside, F.lit(i * PROBES) + F.least(F.lit(PROBES - 1), part).cast("long")).otherwise(cell)
    got = rows.select(cell.alias("c"), "size").filter(F.col("c").isNotNull()).groupBy("c").agg(F.sum("size").alias("b"))
    out = {i: [0] * PROBES for i in range(len(brackets))}
    for r in got.toLocalIterator():
        out[int(r["c"]) // PROBES][int(r["c"]) % PROBES] = int(r["b"])
    return out


def find_boundaries(rows: DataFrame, value: str, wanted: dict[int, int], lo: int, hi: int, below: int,
                    slack: int, rounds: list | None = None) -> dict[int, tuple[int, int, bool]]:
    """For each wanted byte position: ``(key, bytes below key, settled)``.

    ``below``: bytes before ``lo``.  A boundary is the first key of the next
    shard; it is unsettled when all bytes around it belong to one key.
    """
    done: dict[int, tuple[int, int, bool]] = {}
    open_: dict[int, tuple[int, int, int]] = {j: (lo, hi, below) for j in wanted}
    while open_:
        keys = sorted({(a, b) for a, b, _ in open_.values()})
        brackets = [(a, b, max(1, -(-(b - a + 1) // PROBES))) for a, b in keys]
        if rounds is not None:
            rounds.append(len(brackets))
        cells = _cells(rows, value, brackets)
        again: dict[int, tuple[int, int, int]] = {}
        for j, (a, b, base) in open_.items():
            i = keys.index((a, b))
            step = brackets[i][2]
            edges = [base]
            for x in cells[i]:
                edges.append(edges[-1] + x)
            near = min(range(PROBES + 1), key=lambda p: (abs(edges[p] - wanted[j]), p))
            if abs(edges[near] - wanted[j]) <= slack:
                done[j] = (min(a + near * step, b + 1, HIGHEST), edges[near], True)
                continue
            p = min(PROBES - 1, max(0, bisect.bisect_right(edges, wanted[j]) - 1))
            left, right = a + p * step, min(b, a + (p + 1) * step - 1)
            if left == right:
                done[j] = (left, edges[p], False)
            else:
                again[j] = (left, right, edges[p])
        open_ = again
    return done


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE,
              rounds: list | None = None) -> list[tuple[int, int]]:
    """``(key, tie)`` of the first row of shards 1, 2, ...; ``rows`` has
    ``key, tie, size`` and is read once per round."""
    st = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("n")).first()
    if not st["n"]:
        return [(LOWEST, LOWEST)] * (shards - 1)
    total = int(st["n"])
    slack = int(tolerance * total / shards)
    wanted = {j: j * total // shards for j in range(1, shards)}
    found = find_boundaries(rows, "key", wanted, int(st["lo"]), int(st["hi"]), 0, slack, rounds)
    out = {j: (key, LOWEST) for j, (key, _, _) in found.items()}
    heavy: dict[int, list[int]] = {}
    for j, (key, _, settled) in found.items():
        if not settled:
            heavy.setdefault(key, []).append(j)
    for key, js in heavy.items():  # at most one per boundary
        own = rows.filter(F.col("key") == key)
        t = own.agg(F.min("tie").alias("lo"), F.max("tie").alias("hi")).first()
        base = found[js[0]][1]
        if t["lo"] == t["hi"]:
            continue  # one row: it stays whole
        inner = find_boundaries(own, "tie", {j: wanted[j] for j in js}, int(t["lo"]), int(t["hi"]), base, slack, rounds)
        out.update({j: (key, tie) for j, (tie, _, _) in inner.items()})
    return [out[j] for j in sorted(out)]


def shard_of(points: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below the row's (key, tie)."""
    n = F.lit(0)
    for key, tie in points:
        n = n + ((F.col("key") > key) | ((F.col("key") == key) & (F.col("tie") >= tie))).cast("int")
    return n


def number_slots(rows: DataFrame, salts: int) -> DataFrame:
    """Gapless ``slot`` per shard: rows are exchanged once on (shard, salt),
    numbered by (key, tie) there, and moved up by the counts of the earlier
    salts (one row per shard and salt)."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "tie"), F.lit(salts)).cast("int"))
    w = Window.partitionBy("shard", "salt").orderBy("key", "tie")
    s = cut(salted.withColumn("__n", F.row_number().over(w)))
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (s.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("c"))
              .select("shard", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__start")))
    return s.join(starts, ["shard", "salt"]).withColumn("slot", (F.col("__start") + F.col("__n") - 1).cast("long"))


def shard_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shards: int = SHARDS,
                    tolerance: float = TOLERANCE, rows_per_salt: int = 100_000,
                    rounds: list | None = None) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    rows = cut(docs.select(
        F.col(key).alias("__key"), F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("key"),
        F.monotonically_increasing_id().alias("tie"), text_size(F.col(text)).alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32")))
    points = splitters(rows.select("key", "tie", "size"), shards, tolerance, rounds)
    salts = max(8, -(-rows.count() // (shards * rows_per_salt)))
    out = number_slots(rows.withColumn("shard", shard_of(points)), salts)
    return out.select(F.col("__key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"),
                      F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
