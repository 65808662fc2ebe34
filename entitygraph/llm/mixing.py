"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words.  Sources, ordered by code point with
null last, get the given weights in turn and share 100 % of all words; a
target stops at ``max_repeat`` times its source's words and the excess is
shared again by weight (water-filling, solved in closed form over the source
table).  Within a source every document has the same expected number of
copies, ``target / source size``; the documents are put in order (size, then
id), the expected copies are prefix-summed, one random offset per source is
added, and a document is emitted once for each integer boundary its stretch
crosses.  Ordering by size makes the words taken differ from the target by at
most about one longest document.

DataFrame functions only.  The prefix sum is a global rank over a range
partitioning (:func:`entitygraph.plans.iterate.dense_index`), so a source
holding most rows, or one row repeated in most of the table, is spread over all
tasks (documents are read from files, so that a task run again numbers its rows
alike).  The number of partitions follows from the rows and bytes.

Defined cases: null or empty text has size 0 (it can be emitted but takes
nothing); a null source is a source of its own, last in order; a source
without words has target 0 and its documents are not emitted; rows with equal
size and id are interchangeable and each is sampled; an empty table gives an
empty result; other columns are kept by :func:`mix_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dense_index

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and \\t..\\r."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "w")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target, rate, offset`` per source.

    ``sizes``: columns ``source, size``.  The windows below run over one row
    per source, after the documents have been aggregated.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(float(max_repeat))
    order = [(cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if every source before this one (in order of cap / weight) is
    # full; the first source whose cap lies at or above it settles the level
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) \
        / F.sum("weight").over(after)
    s = s.withColumn("__level", level)
    settled = F.min(F.when(cap >= F.col("__level") * F.col("weight"), F.struct((cap / F.col("weight")).alias("k"),
                                                                              F.col("__level").alias("level")))).over(all_rows)
    target = F.when(cap / F.col("weight") < settled["k"], cap).otherwise(
        F.least(cap, settled["level"] * F.col("weight")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(F.concat(F.lit("s"), F.col("source")),
                                                                           F.lit("null")))), 1, 8), 16, 10)
    s = s.withColumn("target", F.coalesce(target, F.lit(0.0)))
    return s.select("source", "source_size", "target",
                    F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
                    (draw.cast("double") / F.lit(4294967296.0)).alias("offset"))


def sample_copies(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``source_size, target, copies`` to rows with ``source, size, __key``.

    The rows are ranked once over (source, size, key): the rank less the
    source's first rank is the position within the source.
    """
    idx = dense_index(rows, [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("__key").asc_nulls_last()],
                      "__rank", spread_ties=True)
    first = idx.groupBy("source").agg(F.min("__rank").alias("__first"))
    targets = source_targets(idx.select("source", "size"), weights, max_repeat)
    per_source = cut(targets.join(first, targets["source"].eqNullSafe(first["source"])).select(
        targets["source"], "source_size", "target", "rate", "offset", "__first"))
    # each source's ranks are one run, so its documents find their source's
    # row by key; a source with many rows is split by its rank blocks
    return with_source_row(idx, per_source)


#: Sources up to this number are broadcast; beyond it the join shuffles on (source, salt).
BROADCAST_SOURCES = 10_000
SALTS = 64


def with_source_row(idx: DataFrame, per_source: DataFrame) -> DataFrame:
    cols = ["source_size", "target", "rate", "offset", "__first"]
    right = per_source.select(F.col("source").alias("__s"), *cols)
    if right.count() <= BROADCAST_SOURCES:
        j = idx.join(F.broadcast(right), idx["source"].eqNullSafe(F.col("__s")))
    else:
        salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = idx.withColumn("__t", F.pmod(F.col("__rank"), F.lit(SALTS)).cast("int"))
        j = left.join(salted, left["source"].eqNullSafe(salted["__s"]) & (left["__t"] == salted["__salt"]))
    at = (F.col("__rank") - F.col("__first")).cast("double")
    copies = (F.floor((at + 1) * F.col("rate") + F.col("offset")) - F.floor(at * F.col("rate") + F.col("offset")))
    return j.withColumn("copies", F.least(copies, F.ceil(F.col("rate"))).cast("long")) \
            .drop("__s", "__salt", "__t", "__rank", "__first", "rate", "offset")


def plan_mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id",
             weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``key, source, size, source_size, target, copies, taken`` per document."""
    rows = cut(docs.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("source"),
                           word_count(F.col(text)).alias("size")))
    got = sample_copies(rows, weights, max_repeat)
    return got.select(F.col("__key").alias(key), "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id",
                  weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: every document as many times as it was drawn, with
    exactly its own columns."""
    # the rows travel with the ranking, so the texts are exchanged once and
    # nothing is joined back to them
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__key"),
                       F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    drawn = sample_copies(rows, weights, max_repeat).filter(F.col("copies") > 0)
    return drawn.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).select("__row.*")
