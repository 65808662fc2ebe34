"""Breadth-first layers and the organised (grid of rings) layout table."""

from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import metric_column, to_number
from ..plans.iterate import bounded_threshold, bucketed, cut, dense_index, release, resident_partitions, salted_join
from ..schema import LAYOUT_CELL_H, LAYOUT_MIN_CELL_W, LAYOUT_RING_STEP, LAYOUT_TOP
from ..session import remove_path, scratch_path, ship_package
from .clean import Graph
from .components import component_members, component_roots, component_scores, connected_components

#: A component of at most so many edges is walked inside one task.
SMALL_EDGES = 200_000
#: A walk from seeds that is deeper than this labels the whole graph instead.
SEED_LAYERS = 64


def undirected_adjacency(edges: DataFrame) -> DataFrame:
    """``(u, v)``: distinct neighbour pairs in both directions, no self-loops."""
    e = edges.filter(F.col("src") != F.col("dst"))
    both = (e.select(F.col("src").alias("u"), F.col("dst").alias("v"))
             .unionByName(e.select(F.col("dst").alias("u"), F.col("src").alias("v"))))
    return both.distinct()


def resident_adjacency(edges: DataFrame, hub_degree: int = 1_000_000, max_hubs: int = 100_000,
                       partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(u, salt, v, v_nsalt)``: the undirected adjacency, written once and
    bucketed by ``(u, salt)`` so repeated joins on ``u`` never move it; and
    ``(u, nsalt)`` of its hubs.

    A vertex with more than ``threshold`` neighbours is spread over
    ``ceil(deg / threshold)`` salts (``salt = xxhash64(v) mod nsalt``); the
    threshold is at least ``|adj| / max_hubs``, so the hub table that is
    broadcast (once) has at most ``max_hubs`` rows.  Each row also carries
    the neighbour's salt count, so a frontier built from it can be exploded
    without another join.
    """
    spark = edges.sparkSession
    adj = undirected_adjacency(edges)
    deg = cut(adj.groupBy("u").agg(F.count(F.lit(1)).alias("deg")))
    m = int(deg.agg(F.sum("deg").alias("m")).first()["m"] or 0)
    threshold = bounded_threshold(m, hub_degree, max_hubs)
    parts = resident_partitions(spark, m, partitions=partitions)
    hubs = cut(deg.filter(F.col("deg") > threshold)
               .select("u", F.ceil(F.col("deg") / F.lit(threshold)).cast("int").alias("nsalt")))
    release(deg)
    few = F.broadcast(hubs)
    adj = (adj.join(few, "u", "left")
              .join(few.select(F.col("u").alias("v"), F.col("nsalt").alias("v_nsalt")), "v", "left")
              .select("u", F.when(F.col("nsalt").isNull(), F.lit(0))
                      .otherwise(F.pmod(F.xxhash64("v"), F.col("nsalt"))).cast("int").alias("salt"),
                      "v", F.coalesce("v_nsalt", F.lit(1)).cast("int").alias("v_nsalt")))
    return bucketed(adj, ["u", "salt"], parts), hubs


def walk(edges: np.ndarray, roots: np.ndarray, n: int) -> np.ndarray:
    """Undirected distance of ``n`` nodes from the nearest root (-1: none)."""
    src, dst = np.concatenate([edges[0], edges[1]]), np.concatenate([edges[1], edges[0]])
    dst = dst[np.argsort(src, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    dist, front, depth = np.full(n, -1), np.unique(roots), 0
    while len(front):
        dist[front] = depth
        size = first[front + 1] - first[front]
        at = np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        near = dst[at]
        front, depth = np.unique(near[dist[near] < 0]), depth + 1
    return dist


def walked_at_once(edges: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """``(component, id, root, layer)`` of whole components of bounded size:
    each lies in one of ``parts`` groups, which a task walks in memory, so the
    depth costs no jobs.  ``edges``: ``label, src, dst``; ``roots``: ``label,
    component, root``."""

    def walk_part(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        is_root = frame["dst"].isna().to_numpy()
        ends = frame["src"].where(~is_root, frame["root"])
        code, names = pd.factorize(np.concatenate([ends.to_numpy(), frame["dst"].to_numpy()[~is_root]]))
        a, b = code[:len(frame)], code[len(frame):]
        dist = walk((a[~is_root], b), a[is_root], len(names))
        # a node's component is that of any of its rows
        comp, labels = pd.factorize(frame["label"])
        of = np.zeros(len(names), np.int64)
        of[a] = comp
        of[b] = comp[~is_root]
        told = frame[is_root].set_index("label").reindex(labels)
        reached = np.flatnonzero(dist >= 0)
        return pd.DataFrame({"component": told["component"].to_numpy()[of[reached]], "id": names[reached],
                             "root": told["root"].to_numpy()[of[reached]], "layer": dist[reached].astype(np.int32)})

    rows = (edges.select("label", "src", "dst", F.lit(None).cast("string").alias("component"), F.lit(None).cast("string").alias("root"))
            .unionByName(roots.select("label", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"),
                                      "component", "root")))
    part = F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int")
    ship_package(edges.sparkSession)
    return rows.withColumn("part", part).groupBy("part").applyInPandas(
        walk_part, "component string, id string, root string, layer int")


def bfs_layers(graph: Graph, roots: DataFrame, *, components: DataFrame | None = None, hub_degree: int = 1_000_000,
               max_hubs: int = 100_000, small_edges: int = SMALL_EDGES) -> DataFrame:
    """``(component, id, root, layer)``: undirected BFS distance from each
    component's root (one root to a component), all components at once.

    A component of at most ``small_edges`` edges is walked inside one task
    (:func:`walked_at_once`): one job for all of them, however deep they are.  The
    others go layer by layer over the whole cluster (:func:`walked_by_layers`).
    ``components``: those of ``graph``, if they are known.  Vertices that no root
    reaches are absent.
    """
    spark = graph.edges.sparkSession
    comps = components if components is not None else connected_components(graph)
    label = comps.select("id", F.col("component").alias("label"))
    e = graph.edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
    e = cut(salted_join(e, label.withColumnRenamed("id", "src"), "src", "dst"))
    sizes = cut(e.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    starts = cut(roots.select("component", "root").join(label.withColumnRenamed("id", "root"), "root")
                 .join(sizes, "label", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    large = sizes.filter(F.col("n") > small_edges)
    total = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") <= small_edges, F.col("n"))), F.lit(0)),
                      F.count_if(F.col("n") > small_edges)).first()
    some = int(total[1]) > 0
    within = salted_join(e, large.select("label"), "label", "src", "left_anti") if some else e
    parts = resident_partitions(spark, int(total[0]) + starts.count(), max(1, 2 * small_edges))
    out = cut(walked_at_once(within, starts.filter(F.col("n") <= small_edges), parts))
    if some:
        beyond = salted_join(e, large.select("label"), "label", "src", "left_semi")
        out = out.unionByName(walked_by_layers(beyond, starts.filter(F.col("n") > small_edges), hub_degree, max_hubs))
    release(e, sizes, starts)
    return out


def walked_by_layers(edges: DataFrame, roots: DataFrame, hub_degree: int, max_hubs: int,
                     adjacency: tuple[DataFrame, DataFrame] | None = None,
                     max_layers: int | None = None) -> DataFrame | None:
    """``(component, id, root, layer)``, a few jobs a layer.

    In an undirected graph every neighbour of layer d lies in layer d-1, d or
    d+1, so the next frontier is the neighbours of layer d minus layers d and
    d-1: each round's anti-joins are frontier-sized, never against a growing
    visited set.  The adjacency stays in its buckets (:func:`resident_adjacency`)
    and the frontier is shuffled to them.  Each layer is written as one partition
    of one table, which the result reads in a single scan whatever the depth.

    ``adjacency``: that of ``edges``, if it is written already (it then stays).
    ``max_layers``: give up and return None when there are more.
    """
    spark = edges.sparkSession
    adj, hubs = adjacency or resident_adjacency(edges, hub_degree, max_hubs)
    table = scratch_path(spark, "layers")

    def written(frontier: DataFrame, depth: int) -> DataFrame:
        path = os.path.join(table, f"layer={depth}")
        frontier.write.parquet(path)
        return spark.read.schema(frontier.schema).parquet(path)

    start = (roots.select("component", "root", F.col("root").alias("id"))
             .join(F.broadcast(hubs.withColumnRenamed("u", "id")), "id", "left")
             .select("component", "root", "id", F.coalesce("nsalt", F.lit(1)).cast("int").alias("nsalt")))
    layer = 0
    prev, cur = None, written(start, layer)
    while not cur.isEmpty():
        if max_layers is not None and layer >= max_layers:
            remove_path(spark, table)
            return None
        front = cur.select("component", "root", F.col("id").alias("u"),
                           F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt"))
        # id determines component, root and nsalt: grouping on id alone leaves
        # the rows hash-partitioned on id, which the anti-joins below reuse
        nxt = (adj.join(front.hint("shuffle_hash"), ["u", "salt"])
                  .groupBy(F.col("v").alias("id"))
                  .agg(F.max("component").alias("component"), F.max("root").alias("root"),
                       F.max("v_nsalt").alias("nsalt")))
        for known in (cur, prev):
            if known is not None:
                nxt = nxt.join(known.select("id"), "id", "left_anti")
        layer += 1
        prev, cur = cur, written(nxt.select("component", "root", "id", "nsalt"), layer)
    if adjacency is None:
        release(adj, hubs)
    return (spark.read.schema("component string, root string, id string, layer int").parquet(table)
            .select("component", "id", "root", "layer"))


def seed_components(graph: Graph, seeds: DataFrame, *, hub_degree: int = 1_000_000, max_hubs: int = 100_000,
                    max_layers: int = SEED_LAYERS, adjacency: tuple[DataFrame, DataFrame] | None = None,
                    stats: dict | None = None) -> DataFrame:
    """``(component, id)``: every vertex of every component that holds a seed
    (the first column of ``seeds``), each once; ``component`` is its smallest id.

    All seeds are walked at once over the written adjacency, each vertex being
    expanded by the first seed to reach it, so frontiers that meet go on as one
    and the rest of the graph is not labelled.  Walks of two seeds that touch are
    joined at the end through the distinct pairs of touching seeds.  Seeds that
    are no vertex, and nulls, drop; without seeds the result is empty.

    A layer costs a few jobs: after ``max_layers`` of them the components of the
    whole graph are computed instead, with the same result.  ``adjacency``: from
    :func:`resident_adjacency` of the graph's edges, kept for later calls.
    ``stats`` receives ``labelled``: whether that was done.
    """
    known = cut(seeds.select(F.col(seeds.columns[0]).cast("string").alias("id")).distinct()
                .join(graph.vertices.select("id"), "id", "left_semi"))
    adj, hubs = own = adjacency or resident_adjacency(graph.edges, hub_degree, max_hubs)
    starts = known.select(F.col("id").alias("component"), F.col("id").alias("root"))
    reached = walked_by_layers(graph.edges, starts, hub_degree, max_hubs, own, max_layers)
    if stats is not None:
        stats["labelled"] = reached is None
    if reached is None:
        out = cut(component_members(connected_components(graph), known))
    else:
        met = reached.select(F.col("component").alias("walk"), "id")
        if known.limit(2).count() > 1:
            met = _joined_walks(met, known, adj, hubs)
        least = met.groupBy("walk").agg(F.min("id").alias("component"))
        out = cut(salted_join(met, least, "walk", "id").select("component", "id"))
    if adjacency is None:
        release(*own)
    release(known)
    return out


def _joined_walks(met: DataFrame, seeds: DataFrame, adj: DataFrame, hubs: DataFrame) -> DataFrame:
    """``(walk, id)`` with the walks of one component under one name.  Only the
    neighbours of walked vertices are read, from their buckets."""
    at = (met.join(F.broadcast(hubs.withColumnRenamed("u", "id")), "id", "left")
          .select("walk", F.col("id").alias("u"),
                  F.explode(F.sequence(F.lit(0), F.coalesce("nsalt", F.lit(1)) - 1)).alias("salt")))
    beside = adj.join(at.hint("shuffle_hash"), ["u", "salt"]).select("walk", F.col("v").alias("id")).distinct()
    pairs = cut(salted_join(beside, met.withColumnRenamed("walk", "other"), "id", "walk")
                .filter(F.col("walk") < F.col("other"))
                .select(F.col("walk").alias("src"), F.col("other").alias("dst")).distinct())
    if not pairs.isEmpty():
        names = connected_components(Graph(seeds, pairs)).select(F.col("id").alias("walk"), "component")
        met = salted_join(met, names, "walk", "id").select(F.col("component").alias("walk"), "id")
    return met


def layered_components(graph: Graph, nodes: DataFrame, mode: str = "static",
                       components: DataFrame | None = None) -> DataFrame:
    """Components, their roots (highest metric, ties by id) and BFS layers:
    ``(component, id, root, layer)`` for every vertex (each is reached from the
    root of its component; ``components`` are those of ``graph``)."""
    comps = components if components is not None else connected_components(graph)
    roots = cut(component_roots(comps, nodes, metric_column(mode)))
    out = bfs_layers(graph, roots, components=comps)
    release(roots)
    return out


def organised_layout(graph: Graph, nodes: DataFrame, mode: str = "static", width: float = 1200.0,
                     components: DataFrame | None = None, decimals: int = 3) -> DataFrame:
    """``(component, id, layer, slot, x, y)``: components in a grid ordered by
    score (desc, then component), each drawn as rings around its root.

    ``cols = max(1, ceil(sqrt(#components)))``, ``cellW = max(260, width /
    cols)``, ``cellH = 220``; cell centre ``(col*cellW + cellW/2, row*cellH +
    cellH/2 + 20)``; layer L sits on radius ``42 L`` at angle ``2 pi i / k``
    (i = slot inside the layer ordered by metric desc then id, k = layer size).
    Positions are global ranks (:func:`dense_index`), not windows, so neither
    the component list nor a big layer is ever gathered in one task.
    """
    m = metric_column(mode)
    comps = components if components is not None else connected_components(graph)
    lay = layered_components(graph, nodes, mode, comps)
    scores = cut(component_scores(comps, nodes, m))
    ranked = dense_index(scores, [F.col("score").desc(), F.col("component").asc()], "cidx")
    n_comp = scores.agg(F.count(F.lit(1))).scalar()
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(n_comp.cast("double"))))
    cell_w = F.greatest(F.lit(LAYOUT_MIN_CELL_W), F.lit(float(width)) / cols)
    cells = ranked.select(
        "component",
        ((F.col("cidx") % cols) * cell_w + cell_w / 2).alias("cx"),
        (F.floor(F.col("cidx") / cols) * F.lit(LAYOUT_CELL_H) + F.lit(LAYOUT_CELL_H / 2 + LAYOUT_TOP)).alias("cy"))

    # written once: the index counts, samples and sorts its input
    v = cut(lay.join(nodes.select("id", to_number(m).alias("m")), "id", "left")
            .select("component", "id", "layer", F.coalesce("m", F.lit(0.0)).alias("m")))
    order = [F.col("component").asc(), F.col("layer").asc(), F.col("m").desc(), F.col("id").asc()]
    idx = dense_index(v, order, "gidx")
    release(v)
    groups = idx.groupBy("component", "layer").agg(F.min("gidx").alias("first"),
                                                   F.count(F.lit(1)).alias("k"))
    # groups are few beside their rows; a big layer's rows are spread over salts
    places = salted_join(groups, cells, "component", "layer")
    slots = salted_join(idx.drop("m"), places, ["component", "layer"], "id").withColumn(
        "slot", F.col("gidx") - F.col("first"))
    angle = F.lit(2 * math.pi) * F.col("slot") / F.greatest(F.col("k"), F.lit(1))
    radius = F.col("layer") * F.lit(LAYOUT_RING_STEP)
    ring = F.col("layer") == 0
    x = F.col("cx") + F.when(ring, F.lit(0.0)).otherwise(radius * F.cos(angle))
    y = F.col("cy") + F.when(ring, F.lit(0.0)).otherwise(radius * F.sin(angle))
    return slots.select(
        "component", "id", "layer", F.col("slot").cast("int").alias("slot"),
        F.round(x, decimals).alias("x"), F.round(y, decimals).alias("y"))
