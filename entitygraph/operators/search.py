"""Search and focus: exact, trimmed, case-insensitive match on id or label,
then the match's component (nodes in it, edges with both ends in it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import known_ends
from ..sources.files import ID_KEY, LABEL_KEY, snapshot_nodes
from .clean import Graph
from .layers import seed_components


def search(nodes: DataFrame, query: str, first: bool = True) -> DataFrame:
    """Nodes whose id or label equals ``query`` (trimmed, lower-cased).

    ``first=True`` keeps the smallest matching id (a top-1, merged from
    per-partition top-1s).  A blank query matches nothing.
    """
    q = (query or "").strip().lower()
    if not q:
        return nodes.limit(0)
    hit = ((F.lower(F.coalesce(F.col("id"), F.lit(""))) == F.lit(q))
           | (F.lower(F.coalesce(F.col("label"), F.lit(""))) == F.lit(q)))
    found = nodes.filter(hit)
    return found.orderBy("id").limit(1) if first else found


def search_snapshot(spark: SparkSession, path: str, query: str, first: bool = True) -> DataFrame:
    """:func:`search` of the current snapshot's nodes: the same rows, asked of
    the stored lower-cased columns, so that row groups whose Bloom filters (or
    dictionaries) lack the query are not read."""
    nodes = snapshot_nodes(spark, path)
    q = (query or "").strip().lower()
    if not q or ID_KEY not in nodes.columns:
        return search(nodes.drop(ID_KEY, LABEL_KEY), query, first)
    found = nodes.filter((F.col(ID_KEY) == F.lit(q)) | (F.col(LABEL_KEY) == F.lit(q))).drop(ID_KEY, LABEL_KEY)
    return found.orderBy("id").limit(1) if first else found


def focus(graph: Graph, nodes: DataFrame, query: str,
          components: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the first match's component; empty when no match.

    Without ``components`` the component is walked from the match alone
    (:func:`seed_components`), the rest of the graph is not labelled.
    """
    match = search(nodes, query, first=True).select("id")
    if components is None:
        members = seed_components(graph, match).select("id")
    else:
        target = F.broadcast(match.join(components, "id").select("component"))     # at most one row
        members = components.join(target, "component", "left_semi").select("id")
    return nodes.join(members, "id", "left_semi"), known_ends(graph.edges, members)
