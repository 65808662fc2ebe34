"""Vector code compression: integer product codes learned by member-resident Lloyd.

Each component x becomes the integer floor(4096 x); vectors are cut into
``PARTS`` consecutive parts, and each part position has a codebook of at most
``ENTRIES`` entries.  A codebook starts as that part of the vectors with the
least ids; a round assigns every part to its nearest entry (squared Euclidean
distance, ties to the lower index) and replaces each used entry by the floor of
its parts' mean.  All arithmetic is on integers, so the result does not depend on
how rows are dealt.

The parts live with their owner: a table bucketed by (position, entry, salt).
An owner sums its resident members in place (the buckets are read without an
exchange) and its sums are added up per entry.  In the next assignment every
part is compared where it lies; parts that keep their entry are written where
they are, and only those that change it go through a shuffle to their new owner.
The salt is a hash of the row, so an entry that most parts choose (one vector
repeated in most rows) has as many owners as half the buckets, and an owner has
at most about ``BUCKET_ROWS`` / 4 members.  The driver holds the codebooks (at most
``ENTRIES`` vectors) and nothing that grows with the table.

Defined cases: rows whose vector is null, empty or holds null or non-finite
components are dropped, and so are vectors of another than the most frequent
length (ties: the shorter); a length that is no multiple of ``PARTS`` is cut at
floor(j * length / PARTS); zero vectors are kept; repeated rows are coded each; of
rows with one id the lesser vector starts first, null ids last; with fewer rows than
``ENTRIES`` the codebooks are as short; components beyond the range in which
squared distances stay exact in 64 bits (for 64 dimensions 2^27, x = 32768) count as
its end; a sum of errors beyond a long counts as the largest long; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import bucketed, release, resident_partitions, salted_join
from .common import cut, give_back

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: A bucket holds about so many parts; an owner at most about a quarter of them.
BUCKET_ROWS = 1_000_000
_LONG = (1 << 63) - 1


def finite(vec: Column) -> Column:
    """Not null or empty, no null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True))


def component_limit(length: int) -> int:
    """The largest magnitude of a component with which a distance of two
    vectors stays below 2^62."""
    return min(math.isqrt((1 << 62) // max(1, length)) // 2, (1 << 31) - 1)


def as_integers(vectors: np.ndarray) -> np.ndarray:
    limit = component_limit(vectors.shape[1])
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -limit, limit).astype(np.int32)


def part_bounds(length: int) -> list[int]:
    return [j * length // PARTS for j in range(PARTS + 1)]


def nearest_entry(values: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry (the lowest of equal ones) and its
    squared distance."""
    d = ((values[:, None, :].astype(np.int64) - entries[None, :, :]) ** 2).sum(2)
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def assigned(pos: pd.Series, part: pd.Series, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and distance of packed parts of mixed positions."""
    at, far = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    of = pos.to_numpy()
    for j in np.unique(of):
        here = np.flatnonzero(of == j)
        if books[j].shape[1]:
            raw = np.frombuffer(b"".join(part.iloc[here]), np.int32).reshape(len(here), -1)
            at[here], far[here] = nearest_entry(raw, books[j])
    return at, far


def parts_of(rows: DataFrame) -> DataFrame:
    """``row, pos, part`` of rows with ``row, v`` (vectors of one length)."""

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = as_integers(np.stack(f["v"].to_numpy()))
                b = part_bounds(x.shape[1])
                for j in range(PARTS):
                    own = np.ascontiguousarray(x[:, b[j]:b[j + 1]])
                    yield pd.DataFrame({"row": f["row"], "pos": j, "part": [y.tobytes() for y in own]})
        give_back()

    return rows.select("row", "v").mapInPandas(cut_up, "row long, pos int, part binary")


def owner_sums(members: DataFrame) -> DataFrame:
    """``pos, entry, at, total, n``: componentwise sums of each entry's parts.
    Owners add their resident members, then their sums are added per entry."""

    def add(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(frame["part"]), np.int32).reshape(len(frame), -1)
        return pd.DataFrame({"pos": [key[0]], "entry": [key[1]], "sums": [raw.sum(0, dtype=np.int64)], "n": [len(frame)]})

    own = members.groupBy("pos", "entry", "salt").applyInPandas(add, "pos int, entry int, sums array<long>, n long")
    return (own.select("pos", "entry", "n", F.posexplode("sums").alias("at", "s"))
            .groupBy("pos", "entry", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("total"),
                                               F.sum("n").alias("n")))


def updated(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Codebooks after an update: at most ``ENTRIES`` vectors come to the driver."""
    out = [b.copy() for b in books]
    for r in sums.collect():
        out[r["pos"]][r["entry"], r["at"]] = int(r["total"]) // int(r["n"])
    return out


def train(parts: DataFrame, books: list[np.ndarray], n_rows: int, rounds: int = ROUNDS) -> tuple[list[np.ndarray], DataFrame]:
    """Codebooks after ``rounds`` and the resident table ``row, pos, part, entry,
    salt`` of the last assignment before the final one."""
    spark = parts.sparkSession
    buckets = resident_partitions(spark, PARTS * n_rows, BUCKET_ROWS)
    salts = max(1, buckets // 2)
    owner = ["pos", "entry", "salt"]

    def nearest(books: list[np.ndarray]):
        @F.pandas_udf("int")
        def entry_of(pos: pd.Series, part: pd.Series) -> pd.Series:
            return pd.Series(assigned(pos, part, books)[0]).astype("int32")

        return entry_of("pos", "part")

    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
    members = bucketed(parts.select("row", "pos", "part", nearest(books).alias("entry"), salt.alias("salt")), owner, buckets)
    for r in range(rounds):
        last, books = books, updated(books, owner_sums(members))
        if r + 1 == rounds or all((a == b).all() for a, b in zip(last, books)):
            break                                  # unchanged codebooks change nothing in later rounds
        met = cut(members.withColumn("new", nearest(books)))
        stay = met.filter("new = entry").drop("new")
        move = met.filter("new <> entry").withColumn("entry", F.col("new")).drop("new").repartition(buckets, *owner)
        before, members = members, bucketed(stay.unionByName(move), owner, buckets, cluster=False)
        release(before, met)
    return books, members


def books_text(books: list[np.ndarray]) -> str:
    return ",".join(str(x) for b in books for x in b.reshape(-1).tolist())


def compress(vectors: DataFrame, *, key: str = "vec_id", vec: str = "embedding", label: str = "label",
             rounds: int = ROUNDS) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` of every kept row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vec).alias("v")).filter(finite(F.col("v")))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if length is None:
        return spark.createDataFrame([], f"`{key}` {vectors.schema[key].dataType.simpleString()}, code string, error long, "
                                         "label_error long, codebooks_sha256 string")
    rows = cut(rows.filter(F.size("v") == length["d"]).withColumn("row", F.monotonically_increasing_id()))
    least = rows.orderBy(F.col("id").asc_nulls_last(), F.col("v").asc()).limit(ENTRIES).select("v").collect()
    start, b = as_integers(np.array([r["v"] for r in least], np.float64)), part_bounds(length["d"])
    books, members = train(parts_of(rows), [start[:, b[j]:b[j + 1]].astype(np.int64) for j in range(PARTS)],
                           length["n"], rounds)

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at, far = assigned(f["pos"], f["part"], books)
            yield pd.DataFrame({"row": f["row"], "pos": f["pos"], "entry": at, "far": far})

    ended = members.select("row", "pos", "part").mapInPandas(final, "row long, pos int, entry int, far long")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))),
                         lambda x: F.lower(F.lpad(F.hex(x["entry"]), 2, "0")))
    coded = ended.groupBy("row").agg(F.array_join(digits, "").alias("code"), F.sum("far").alias("error"))
    told = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    coded = cut(rows.select("row", "id", told.alias("told")).join(coded, "row"))
    release(members)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    out = salted_join(coded, coded.groupBy("told").agg(total.alias("label_error")), "told", "row")
    sha = hashlib.sha256(books_text(books).encode()).hexdigest()
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
