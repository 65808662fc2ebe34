"""Graph construction: clean vertices, referentially valid edges.

Decisions (see README): metrics are keyed by ``id``; duplicate ids keep the
row seen most recently; edges with an unknown end are dropped, kept (the end
becomes a vertex without attributes) or rejected, by policy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_date
from ..plans.iterate import cut, few_rows, known_ends, salted_join

_NULL_DATE_KEY = 2 ** 31 - 1


@dataclass(frozen=True)
class Graph:
    """A property graph as two DataFrames.

    ``vertices``: ``id, t, label, last_seen(date)`` with unique non-null ids.
    ``edges``: ``src, dst`` (directed; parallel edges and self-loops kept).
    """

    vertices: DataFrame
    edges: DataFrame


def _vertex_columns(raw: DataFrame) -> DataFrame:
    t = F.col("t") if "t" in raw.columns else (F.col("type") if "type" in raw.columns else F.lit(None))
    label = F.col("label") if "label" in raw.columns else F.lit(None)
    seen = F.col("last_seen") if "last_seen" in raw.columns else F.lit(None)
    return raw.select(
        F.col("id").cast("string").alias("id"),
        t.cast("string").alias("t"),
        label.cast("string").alias("label"),
        as_date(seen).alias("last_seen"),
    )


def valid_vertices(raw: DataFrame) -> DataFrame:
    """Null ids dropped; one row per id, the most recently seen wins.

    Ties go to the smallest ``(t, label)``.  Written as ``min(struct)`` per id:
    a partial (map-side) aggregate, so an id repeated in a third of all rows
    is combined before the shuffle instead of landing in one window task.
    """
    v = _vertex_columns(raw).filter(F.col("id").isNotNull())
    newest_first = F.coalesce(-F.unix_date("last_seen"), F.lit(_NULL_DATE_KEY))
    best = F.min(F.struct(newest_first.alias("k"), "t", "label", "last_seen")).alias("b")
    return v.groupBy("id").agg(best).select("id", "b.t", "b.label", "b.last_seen")


def _edge_columns(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))


def vertex_universe(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ids named by the vertex table or by either end of an edge."""
    ids = (vertices.select("id")
           .unionByName(edges.select(F.col("src").alias("id")))
           .unionByName(edges.select(F.col("dst").alias("id"))))
    return ids.filter(F.col("id").isNotNull()).distinct()


def dangling_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is not a vertex id, each once (also where both
    ends are unknown)."""
    e = _edge_columns(edges).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    ids = vertices.select("id")
    known_src = ids.withColumnRenamed("id", "src")
    bad_src = salted_join(e, known_src, "src", "dst", "left_anti")
    good_src = salted_join(e, known_src, "src", "dst", "left_semi")
    bad_dst = salted_join(good_src, ids.withColumnRenamed("id", "dst"), "dst", "src", "left_anti", counted=e)
    return bad_src.unionByName(bad_dst)


def valid_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose two ends are known vertices (duplicates kept).

    Two ``left_semi`` joins: the id side is a key set, so no row of the edge
    table is multiplied; the edges of a hot end are spread over salts.
    """
    e = _edge_columns(edges).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return known_ends(e, vertices, counted=edges if few_rows(edges) else None)


def build_graph(raw_vertices: DataFrame, raw_edges: DataFrame, dangling: str = "drop",
                materialize: bool = False) -> Graph:
    """Clean both tables into a :class:`Graph`.

    ``dangling``: ``drop`` (default) removes edges with an unknown end,
    ``keep`` adds the missing ends as vertices without attributes,
    ``error`` raises when any edge has an unknown end.
    ``materialize=True`` materialises both cleaned tables once, for callers
    that read the graph many times (every iterative operator does).
    """
    v = valid_vertices(raw_vertices)
    if materialize:
        v = cut(v)
        g = _build(v, raw_edges, dangling)
        return Graph(g.vertices if dangling != "keep" else cut(g.vertices), cut(g.edges))
    return _build(v, raw_edges, dangling)


def _build(v: DataFrame, raw_edges: DataFrame, dangling: str) -> Graph:
    e = _edge_columns(raw_edges).filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if dangling == "drop":
        return Graph(v, valid_edges(raw_edges, v))
    if dangling == "keep":
        missing = vertex_universe(v.limit(0), e).join(v.select("id"), "id", "left_anti")
        extra = missing.select("id", F.lit(None).cast("string").alias("t"),
                               F.lit(None).cast("string").alias("label"),
                               F.lit(None).cast("date").alias("last_seen"))
        return Graph(v.unionByName(extra), e)
    if dangling == "error":
        bad = dangling_edges(v, e).limit(1).count()
        if bad:
            raise ValueError("edge table names vertices that are not in the vertex table")
        return Graph(v, e)
    raise ValueError(f"unknown dangling policy: {dangling!r}")
