"""Undirected connected components by alternating large-star / small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond",
SoCC 2014).  Rounds grow with log(diameter), not with the diameter, so a
long path converges in a handful of rounds.

Each step is two aggregates and one join per edge set.  The join that meets
every edge with its source's minimum neighbour would put a star centre (a
component with a third of all vertices ends as one star) into one task, so it
goes through :func:`split_hub_join`: heavy keys are broadcast (their count is
bounded by ``2|E| / threshold``), light keys shuffle.

Before the first round every task contracts its own edges: a union-find over
at most ``LOCAL_EDGES`` of them at a time leaves a star per local component, so
the first shuffles carry at most a row per vertex and task, not the edges.

Stop test per round: row count and an order-free 64-bit hash sum of the edge
set equal the previous round's.  It is then confirmed exactly (no vertex is
both a centre and a leaf, i.e. the edge set is a forest of stars centred on
their minimum) before labels are read off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import bounded_threshold, cut, release, salted_join, split_hub_join
from ..session import give_back, ship_package
from .clean import Graph


def _stats(ee: DataFrame) -> tuple[int, object]:
    r = ee.agg(F.count(F.lit(1)).alias("n"),
               F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(r["n"]), r["h"]


def _is_star_forest(ee: DataFrame) -> bool:
    centres = ee.select("a").distinct()
    both = ee.select(F.col("b").alias("a")).join(centres, "a", "left_semi")
    return both.limit(1).count() == 0


#: With more edges than this, no join of a round sends a side through the driver.
MAX_SENT = 100_000
#: Edges that a task contracts at a time.
LOCAL_EDGES = 500_000


def least_members(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the component of each of ``n`` nodes under edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (up := new[new]).tobytes() != new.tobytes():
            new = up
        if (new == label).all():
            return label
        label = new


def local_stars(edges: DataFrame) -> DataFrame:
    """``(a, b)``: edges with the components of ``edges`` (columns of one type),
    each task's own contracted to stars around their least vertex."""
    kind = edges.schema[0].dataType.simpleString()

    def contract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, rows = [], 0
        for f in frames:
            kept.append(f)
            rows += len(f)
            if rows >= LOCAL_EDGES:
                yield stars(kept)
                kept, rows = [], 0
        if rows:
            yield stars(kept)
        give_back()

    def stars(frames: list[pd.DataFrame]) -> pd.DataFrame:
        ends = np.concatenate([f.iloc[:, i].to_numpy() for i in (0, 1) for f in frames])
        code, names = pd.factorize(ends, sort=True)
        low = least_members(len(names), code[:len(code) // 2], code[len(code) // 2:])
        leaves = np.flatnonzero(low != np.arange(len(names)))
        return pd.DataFrame({"a": names[low[leaves]], "b": names[leaves]})

    ship_package(edges.sparkSession)
    return edges.mapInPandas(contract, f"a {kind}, b {kind}")


def connected_components(graph: Graph, *, hub_degree: int = 1_000_000, max_hubs: int = 100_000,
                         stats: dict | None = None) -> DataFrame:
    """``(id, component)`` for every vertex; ``component`` is the smallest id
    (string order) in the vertex's undirected component.  Isolated vertices
    and vertices with only self-loops are their own component.

    ``stats``: optional dict that receives ``rounds`` (star-step pairs run).
    """
    e = graph.edges.filter(F.col("src") != F.col("dst"))
    ee = cut(local_stars(e.select("src", "dst")).distinct())
    n, h = _stats(ee)
    rounds = 0
    while n:  # to the fixed point: rounds grow with the log of the diameter
        rounds += 1
        thr = bounded_threshold(2 * n, hub_degree, max_hubs)
        # large-star: every neighbour larger than u is linked to min(N(u) + u)
        sym = (ee.select(F.col("a").alias("u"), F.col("b").alias("v"))
                 .unionByName(ee.select(F.col("b").alias("u"), F.col("a").alias("v"))))
        # read by the hub broadcast, the light-key join and nothing else: one
        # materialised copy instead of one aggregation of 2|E| rows per branch
        mins = cut(sym.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg"))
                   .select("u", F.least("u", "m").alias("m"), "deg"))
        big = ee.select(F.col("a").alias("u"), F.col("b").alias("v"))
        ee1 = cut(split_hub_join(big, mins, "u", "deg", thr, total_weight=n, moved=n > MAX_SENT)
                  .select(F.col("v").alias("u"), "m").distinct())          # u > m
        release(mins)
        # small-star: u and its smaller neighbours are linked to their minimum
        mins2 = cut(ee1.groupBy("u").agg(F.min("m").alias("m2"), F.count(F.lit(1)).alias("deg")))
        j = split_hub_join(ee1, mins2, "u", "deg", thr, total_weight=n, moved=n > MAX_SENT)
        ee2 = (j.select(F.col("m2").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
                .unionByName(mins2.select(F.col("m2").alias("a"), F.col("u").alias("b")))
                .distinct())                                                 # a < b
        before, ee = ee, cut(ee2)
        release(before, ee1, mins2)
        n2, h2 = _stats(ee)
        if (n2, h2) == (n, h) and _is_star_forest(ee):
            break
        n, h = n2, h2
    if stats is not None:
        stats["rounds"] = rounds
    labels = (ee.select(F.col("b").alias("id"), F.col("a").alias("component"))
                .unionByName(ee.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()))
    labels = labels.hint("merge") if n > MAX_SENT else labels
    out = cut(graph.vertices.select("id").join(labels, "id", "left")
              .select("id", F.coalesce("component", "id").alias("component")))
    release(ee)
    return out


def with_component_size(components: DataFrame) -> DataFrame:
    """Add ``component_size``: an aggregate joined back on the component key
    (the rows of a very large component are spread over salts)."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    return salted_join(components, sizes, "component", "id").select("id", "component", "component_size")


def component_of(components: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(seed, component)``: the component of each seed id (unknown ids drop)."""
    s = seeds.select(F.col(seeds.columns[0]).cast("string").alias("seed")).distinct()
    return s.join(components.withColumnRenamed("id", "seed"), "seed").select("seed", "component")


def component_members(components: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(component, id)``: every member of every component that holds a seed.

    Seeds are reduced to their components first (semi join), so each vertex
    appears once however many seeds share its component: no seed x member
    pairs inside a component.
    """
    hit = component_of(components, seeds).select("component").distinct()
    return salted_join(components, hit, "component", "id", "left_semi").select("component", "id")


def component_scores(components: DataFrame, nodes: DataFrame, metric: str = "pr_percent") -> DataFrame:
    """``(component, score, size)``: best metric of each component (start
    value 0, so a component of negative/zero metrics scores 0)."""
    from ..functions.columns import to_number
    j = components.join(nodes.select("id", to_number(metric).alias("m")), "id", "left")
    return j.groupBy("component").agg(
        F.greatest(F.coalesce(F.max("m"), F.lit(0.0)), F.lit(0.0)).alias("score"),
        F.count(F.lit(1)).alias("size"))


def ranked_components(scores: DataFrame) -> DataFrame:
    """``component_scores`` plus ``rank``: 0-based position by score
    descending, then component id (a distributed global index)."""
    from ..plans.iterate import dense_index
    return dense_index(scores, [F.col("score").desc(), F.col("component").asc()], "rank")


def component_count(components: DataFrame) -> DataFrame:
    """One row ``n_components`` (distinct count as a two-level aggregate)."""
    return components.agg(F.count_distinct("component").alias("n_components"))


def component_roots(components: DataFrame, nodes: DataFrame, metric: str = "pr_percent") -> DataFrame:
    """``(component, root)``: the vertex with the highest metric, ties to the
    smallest id; a per-component ``min(struct)`` (partial aggregate)."""
    from ..functions.columns import to_number
    j = components.join(nodes.select("id", to_number(metric).alias("m")), "id", "left")
    best = F.min(F.struct((-F.coalesce("m", F.lit(0.0))).alias("k"), F.col("id").alias("id"))).alias("b")
    return j.groupBy("component").agg(best).select("component", F.col("b.id").alias("root"))
