"""Static PageRank as a DataFrame loop.

Semantics: ``r0 = 1``; each round ``r(v) = reset + (1 - reset) * sum over
in-edges (u -> v) of r(u) / outdeg(u)``; parallel edges count with their
multiplicity, self-loops are ordinary edges, sink rank is not redistributed.
The result is rescaled so the ranks sum to the number of vertices.

Every rank is ``reset`` plus what it got, so the loop carries the excess ``x``
over ``reset``: in round ``t >= 2`` the in-edges of ``v`` give ``reset * s(v)``
plus the sum of ``x(u) / outdeg(u)``, where ``s(v)`` is what round 1 (rank 1
everywhere) gave.  A vertex without in-edges has no excess after round 1 and
sends nothing more.

Physical plan:

* setup: out-degree per source (partial aggregate), one vertex-state table
  ``(id, outdeg, nsalt)`` materialised.
* a source whose out-degree exceeds the hub threshold is split over
  ``nsalt`` salts (``salt = xxhash64(dst) mod nsalt``), so no task owns a
  hub's edges alone; the hub table is broadcast once and holds fewer than
  ``max_hubs`` rows because the threshold is at least ``|E| / max_hubs``.
* round 1 reads the edges as given: one shuffle to the messages, one partial
  aggregate per target.
* only the edges of vertices that got something are collapsed to ``(src, salt,
  dst, mult)`` and written once as a table bucketed by ``(src, salt)``, which
  never moves in the later rounds.
* round: messages ``x / outdeg`` per (source, salt) meet the resident edge
  partitions; contributions are summed per target with a map-side partial
  aggregate (a target receiving a third of all edges is combined before the
  shuffle); vertices that get nothing come in through the same aggregate.
* a vertex whose sources are all at rest is at rest a round later.  It sends
  once more, into a sum that its targets keep, and leaves with its edges: later
  rounds work on what still moves.  Once those edges are half of the stored
  ones, the table is written anew without the others.
* one plan at every size: the messages are shuffled to the edges and hashed
  there.  Nothing is kept in executor memory between rounds.
* while vertices come to rest every round's ranks are cut with a written table
  in the shared checkpoint folder (``plans.iterate.cut``), then those of every
  ``checkpoint_every`` rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import bounded_threshold, bucketed, cut, release, resident_partitions
from ..schema import PAGERANK_ITERATIONS, PAGERANK_RESET


def out_degrees(edges: DataFrame) -> DataFrame:
    """``(src, outdeg)``: edges per source, with multiplicity."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("outdeg"))


def salted_edges(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``(src, salt, dst)``: the edges of a hub are spread over its salts."""
    hubs = F.broadcast(state.filter(F.col("nsalt") > 1).select(F.col("id").alias("src"), "nsalt"))
    salt = F.when(F.col("nsalt").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("dst"), F.col("nsalt")))
    return edges.join(hubs, "src", "left").select("src", salt.cast("int").alias("salt"), "dst")


def resident_weights(edges: DataFrame, state: DataFrame, partitions: int, senders: DataFrame | None = None,
                     few: bool = False) -> DataFrame:
    """``(src, salt, dst, mult)``, written once, bucketed by ``(src, salt)``.

    One shuffle of the raw edges; the aggregate reuses its partitioning, and
    every task writes the one bucket that it holds.  Every round's join reads
    the buckets where they lie, so only the messages move; a lost executor's
    buckets are read again from the files.

    ``senders`` ``(src, salt)``: only their edges; ``few``: small enough to be
    broadcast, so that the other edges are not shuffled either.
    """
    rows, on = salted_edges(edges, state), ["src", "salt"]
    if senders is not None and few:
        rows = rows.join(F.broadcast(senders), on, "left_semi")
    rows = rows.repartition(partitions, *on)
    if senders is not None and not few:
        rows = rows.join(senders.hint("shuffle_hash"), on, "left_semi")
    weights = rows.groupBy("src", "salt", "dst").agg(F.count(F.lit(1)).alias("mult"))
    return bucketed(weights, on, partitions, cluster=False)


def contributions(weights: DataFrame, msgs: DataFrame) -> DataFrame:
    """Messages ``(src, salt, msg)`` along the edges.  The messages are the hash
    side at every size: the edges stream past them, unsorted."""
    return weights.join(msgs.hint("shuffle_hash"), ["src", "salt"])


def _messages(senders: DataFrame) -> DataFrame:
    """``(src, salt, msg, live)``: what each vertex with out-edges sends."""
    return senders.filter(F.col("outdeg") > 0).select(
        F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt"),
        (F.col("x") / F.col("outdeg")).alias("msg"), F.col("moving").alias("live"))


def _first_round(edges: DataFrame, state: DataFrame, reset: float) -> DataFrame:
    """Round 1, where every vertex sends a rank of 1: ``(id, outdeg, nsalt, fixed,
    x, moving)``.  ``fixed``: what the resets of the sources give in every later
    round; ``moving``: it has in-edges."""
    msgs = _messages(state.select("id", "outdeg", "nsalt", F.lit(1.0).alias("x"), F.lit(True).alias("moving")))
    incoming = contributions(salted_edges(edges, state), msgs.drop("live")).select(
        F.col("dst").alias("id"), F.lit(None).cast("long").alias("outdeg"), F.lit(None).cast("int").alias("nsalt"),
        F.col("msg").alias("c"))
    own = state.select("id", "outdeg", "nsalt", F.lit(None).cast("double").alias("c"))
    summed = own.unionByName(incoming).groupBy("id").agg(
        F.max("outdeg").alias("outdeg"), F.max("nsalt").alias("nsalt"), F.sum("c").alias("c"))
    got = F.coalesce("c", F.lit(0.0))
    return summed.select("id", "outdeg", "nsalt", (F.lit(reset) * got).alias("fixed"),
                         (F.lit(1.0 - reset) * got).alias("x"), F.col("c").isNotNull().alias("moving"))


def _round(weights: DataFrame, senders: DataFrame, base: DataFrame, reset: float) -> DataFrame:
    """One later round: ``(id, outdeg, nsalt, fixed, x, moving)`` of the vertices of
    ``base``.  What a sender at rest sends goes into ``fixed`` for good."""
    c = F.col("mult") * F.col("msg")
    incoming = contributions(weights, _messages(senders)).select(
        F.col("dst").alias("id"), F.lit(None).cast("long").alias("outdeg"), F.lit(None).cast("int").alias("nsalt"),
        F.when(F.col("live"), 0.0).otherwise(c).alias("fixed"), F.when(F.col("live"), c).otherwise(0.0).alias("c"), "live")
    own = base.select("id", "outdeg", "nsalt", "fixed", F.lit(0.0).alias("c"), F.lit(False).alias("live"))
    summed = own.unionByName(incoming).groupBy("id").agg(
        F.max("outdeg").alias("outdeg"), F.max("nsalt").alias("nsalt"), F.sum("fixed").alias("fixed"),
        F.sum("c").alias("c"), F.max("live").alias("moving"))
    x = F.lit(1.0 - reset) * (F.col("fixed") + F.col("c"))
    return summed.select("id", "outdeg", "nsalt", "fixed", x.alias("x"), "moving")


def _counts(ranks: DataFrame):
    """Vertices, those that move, those with out-edges, and their out-edges."""
    return ranks.agg(F.count(F.lit(1)).alias("n"), F.count_if("moving").alias("moving"),
                     F.count_if(F.col("outdeg") > 0).alias("senders"),
                     F.coalesce(F.sum("outdeg"), F.lit(0)).alias("edges")).first()


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = PAGERANK_ITERATIONS,
             reset: float = PAGERANK_RESET, *, hub_out_degree: int = 1_000_000,
             max_hubs: int = 100_000,
             partitions: int | None = None, checkpoint_every: int = 5, raw: bool = False) -> DataFrame:
    """``(id, pagerank)`` for every vertex id (ids unique; edge ends must be
    vertex ids, as :func:`entitygraph.build_graph` guarantees).

    ``raw=True`` also returns the unscaled rank as ``raw_rank``.
    ``checkpoint_every``: rounds between reliable checkpoints once no more
    vertices come to rest (before that every round's ranks are written: its
    senders and its next state both read them).  Each of these rounds reads the
    previous ranks once (the state is the written one), so the lineage between
    cuts is a chain, never a tree.
    """
    spark = vertices.sparkSession
    e = edges.select("src", "dst")
    state = (vertices.select("id")
             .join(out_degrees(e).withColumnRenamed("src", "id"), "id", "left")
             .select("id", F.coalesce("outdeg", F.lit(0)).cast("long").alias("outdeg")))
    state = cut(state)
    totals = state.agg(F.count(F.lit(1)).alias("n"), F.sum("outdeg").alias("m")).first()
    n_vertices, n_edges = int(totals["n"]), int(totals["m"] or 0)

    threshold = bounded_threshold(n_edges, hub_out_degree, max_hubs)
    nsalt = F.when(F.col("outdeg") > threshold,
                   F.ceil(F.col("outdeg") / F.lit(threshold))).otherwise(F.lit(1))
    degrees = state
    state = degrees.withColumn("nsalt", nsalt.cast("int"))

    tables, ended, weights, done = [degrees], [], None, min(1, iterations)
    if not done:
        ranks = state.select("id", F.lit(1.0 - reset).alias("x"))
    else:
        first = cut(_first_round(e, state, reset))
        tables.append(first)
        # what got nothing stays at ``reset``, which its targets keep in ``fixed``: it leaves with its edges
        ranks = first.filter("moving")
        ended.append(first.filter(~F.col("moving")))
        now = _counts(ranks)
        settling = 0 < now["n"] < n_vertices
        if done < iterations and now["n"]:
            stored = int(now["edges"])
            parts = resident_partitions(spark, stored, partitions=partitions)
            senders = None if stored == n_edges else _messages(ranks).select("src", "salt")
            weights = resident_weights(e, state, parts, senders, few=now["senders"] <= max_hubs)
        while done < iterations and settling:
            before, ranks = ranks, cut(_round(weights, ranks, ranks.filter("moving"), reset))
            done += 1
            tables.append(ranks)
            ended.append(before.filter(~F.col("moving")))
            now = _counts(ranks)
            settling = 0 < now["moving"] < now["n"]
            if settling and done < iterations - 1 and now["edges"] <= stored // 2:  # so at most 2 |E| are written in all
                stored, whole = int(now["edges"]), weights
                parts = resident_partitions(spark, stored, partitions=partitions)
                live = contributions(whole, _messages(ranks)).select(*whole.columns)
                weights = bucketed(live, ["src", "salt"], parts)
                release(whole)
        if done < iterations and now["moving"]:
            # no vertex came to rest in the last round, so none will: a wave of them follows from the one before
            base = ranks
            for done in range(done + 1, iterations + 1):
                ranks = _round(weights, ranks, base, reset)
                if done % max(1, checkpoint_every) == 0 or done == iterations:
                    ranks = cut(ranks)
                    tables.append(ranks)

    ranks = cut(reduce(DataFrame.unionByName, [f.select("id", "x") for f in ended], ranks.select("id", "x"))
                .select("id", (F.lit(reset) + F.col("x")).alias("r")))
    release(weights, *tables)
    total = ranks.agg(F.sum("r")).scalar()
    scaled = F.try_divide(F.col("r") * F.lit(float(n_vertices)), total)
    cols = [F.col("id"), scaled.alias("pagerank")]
    if raw:
        cols.append(F.col("r").alias("raw_rank"))
    out = ranks.select(*cols)
    out._scratch = ranks._scratch     # what release() of the result deletes
    return out
