"""Subgraph operators: metric threshold, neighbour index, degrees, ego
network and node / neighbour details.  All long-form DataFrames: a hub's
neighbours are rows, never one array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display_label, display_type, metric_column, percent_text, to_number
from ..plans.iterate import cut, known_ends, salted_join


def induced_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in ``kept.id`` (duplicates kept).  The ids are written
    first: both joins read them, and few of them are sent to the edges."""
    return known_ends(edges, cut(kept.select("id")))


def filter_graph(nodes: DataFrame, edges: DataFrame, mode: str = "static",
                 threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``metric >= threshold`` (inclusive; junk metric reads as 0)
    and the edges between them.  A positive threshold is first asked of a
    stored double as it is, so that it reaches the scan of a saved snapshot."""
    m = metric_column(mode)
    if threshold > 0 and dict(nodes.dtypes)[m] == "double":
        nodes = nodes.filter(F.col(m) >= F.lit(float(threshold)))
    kept = (nodes.withColumn("pr_percent", to_number("pr_percent"))
                 .withColumn("pr_temporal_percent", to_number("pr_temporal_percent"))
                 .filter(F.col(m) >= F.lit(float(threshold))))
    return kept, induced_edges(edges, kept)


def neighbour_index(edges: DataFrame) -> DataFrame:
    """``(id, nbr, direction)``: distinct out- and in-neighbours of each vertex."""
    pairs = edges.select("src", "dst").distinct()
    out = pairs.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit("out").alias("direction"))
    inc = pairs.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit("in").alias("direction"))
    return out.unionByName(inc)


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, out_degree, in_degree, out_neighbours, in_neighbours)`` for every
    vertex: edge counts with multiplicity and distinct neighbour counts.

    Pairs are collapsed first (partial aggregate), then both directions and a
    zero row per vertex meet in one aggregate: no outer join.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("mult"))
    z = F.lit(0).cast("long")
    out = pairs.select(F.col("src").alias("id"), F.col("mult").alias("oe"), z.alias("ie"),
                       F.lit(1).cast("long").alias("on"), z.alias("inn"))
    inc = pairs.select(F.col("dst").alias("id"), z.alias("oe"), F.col("mult").alias("ie"),
                       z.alias("on"), F.lit(1).cast("long").alias("inn"))
    base = vertices.select("id", z.alias("oe"), z.alias("ie"), z.alias("on"), z.alias("inn"))
    return (base.unionByName(out).unionByName(inc).groupBy("id")
            .agg(F.sum("oe").alias("out_degree"), F.sum("ie").alias("in_degree"),
                 F.sum("on").alias("out_neighbours"), F.sum("inn").alias("in_neighbours")))


def _seed_frame(spark, seeds) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select(F.col(seeds.columns[0]).cast("string").alias("seed")).distinct()
    if isinstance(seeds, str):
        seeds = [seeds]
    return spark.createDataFrame([(s,) for s in seeds], "seed string").distinct()


def ego_network(nodes: DataFrame, edges: DataFrame, seeds) -> tuple[DataFrame, DataFrame]:
    """Ego network of each seed: ``(seed, id)`` = the seed plus its in- and
    out-neighbours, and ``(seed, src, dst)`` = the edges touching the seed
    (edges between two neighbours are not included; parallel edges kept).

    ``seeds``: one id, a list of ids, or a DataFrame whose first column holds ids.
    """
    s = _seed_frame(nodes.sparkSession, seeds)
    known = s.join(nodes.select(F.col("id").alias("seed")), "seed", "left_semi")
    both = edges.select("src", "dst")
    out = (salted_join(both, known.withColumnRenamed("seed", "src"), "src", "dst", "left_semi", counted=edges)
           .select(F.col("src").alias("seed"), "src", "dst"))
    inc = (salted_join(both, known.withColumnRenamed("seed", "dst"), "dst", "src", "left_semi", counted=edges)
           .select(F.col("dst").alias("seed"), "src", "dst"))
    ego_edges = out.unionByName(inc.filter(F.col("src") != F.col("dst")))
    ego_nodes = (known.select("seed", F.col("seed").alias("id"))
                 .unionByName(out.select("seed", F.col("dst").alias("id")))
                 .unionByName(inc.select("seed", F.col("src").alias("id")))
                 .distinct())
    return ego_nodes, ego_edges


def node_details(nodes: DataFrame) -> DataFrame:
    """Detail panel fields for every node: title, type, label, both percents
    as fixed 3-decimal text, last_seen (``-`` when unknown)."""
    cols = [F.col("id"), display_label("label", "id").alias("title"), display_type("t").alias("type"),
            display_label("label", "id").alias("label"),
            percent_text("pr_percent").alias("pr_text"),
            percent_text("pr_temporal_percent").alias("pr_temporal_text")]
    seen = F.col("last_seen").cast("string") if "last_seen" in nodes.columns else F.lit(None).cast("string")
    cols.append(F.coalesce(F.nullif(seen, F.lit("")), F.lit("-")).alias("last_seen"))
    return nodes.select(*cols)


def neighbour_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, direction, nbr, nbr_label, nbr_type)``: the distinct out-neighbours
    then in-neighbours of every node with the neighbour's label and lower-cased
    type; neighbours that are not nodes are skipped (inner join)."""
    idx = neighbour_index(edges)
    info = nodes.select(F.col("id").alias("nbr"), display_label("label", "id").alias("nbr_label"),
                        F.coalesce(F.nullif(F.lower(F.col("t")), F.lit("")), F.lit("-")).alias("nbr_type"))
    return salted_join(idx, info, "nbr", "id").select("id", "direction", "nbr", "nbr_label", "nbr_type")
