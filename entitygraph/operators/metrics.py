"""Rank percentages, recency weighting, the node metric table and the full
job (paths -> nodes + edges)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_date, metric_column, percent_of, recency_weight_col, sqrt_scale_col, to_number
from ..plans.iterate import cut, release
from ..schema import HALF_LIFE_DAYS, PAGERANK_ITERATIONS, PAGERANK_RESET
from .clean import Graph, build_graph
from .pagerank import pagerank


def as_percent(df: DataFrame, col: str, name: str) -> DataFrame:
    """Add ``name = round(col / sum(col) * 100, 6)``.

    The total is a scalar subquery (one partial aggregate, evaluated once per
    query): no driver round trip, no cross join, no single-partition window.
    """
    total = df.agg(F.sum(col)).scalar()
    return df.withColumn(name, percent_of(col, total))


def _weight(as_of, half_life_days: float, clamp_future: bool):
    w = recency_weight_col("last_seen", as_of or _dt.date.today(), half_life_days)
    return F.least(w, F.lit(1.0)) if clamp_future else w


def recency(vertices: DataFrame, as_of=None, half_life_days: float = HALF_LIFE_DAYS,
            clamp_future: bool = False) -> DataFrame:
    """``(id, last_seen, age_days, recency_weight)``.

    ``as_of`` defaults to today, fixed once on the driver.  Unknown or
    malformed dates weigh 1.0; future dates weigh more than 1 unless
    ``clamp_future``.
    """
    as_of = as_of or _dt.date.today()
    seen = as_date("last_seen")
    age = F.datediff(F.lit(str(as_of)).cast("date"), seen)
    w = _weight(as_of, half_life_days, clamp_future)
    return vertices.select("id", seen.alias("last_seen"), age.alias("age_days"), w.alias("recency_weight"))


def node_metrics(graph: Graph, as_of=None, half_life_days: float = HALF_LIFE_DAYS,
                 iterations: int = PAGERANK_ITERATIONS, reset: float = PAGERANK_RESET,
                 clamp_future: bool = False, ranks: DataFrame | None = None, **pr_options) -> DataFrame:
    """Every vertex with ``pagerank, pr_percent, recency_weight,
    pagerank_temporal, pr_temporal_percent`` (temporal = static rank times the
    recency weight, as a percent of its own total; missing metrics are 0.0).

    The joined table is materialised once so that both totals (scalar
    subqueries) read |V| materialised rows instead of recomputing the job.
    """
    own = None
    if ranks is None:
        own = ranks = pagerank(graph.vertices, graph.edges, iterations, reset, **pr_options)
    m = (graph.vertices.join(ranks, "id", "left")
         .withColumn("recency_weight", _weight(as_of, half_life_days, clamp_future))
         .withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))
         .withColumn("pagerank_temporal", F.col("pagerank") * F.col("recency_weight")))
    m = cut(m)
    release(own)
    m = as_percent(m, "pagerank", "pr_percent")
    m = as_percent(m, "pagerank_temporal", "pr_temporal_percent")
    return m.select("id", "label", "t", "last_seen", "pagerank", "pr_percent",
                    "recency_weight", "pagerank_temporal", "pr_temporal_percent")


def compute_graph(raw_vertices: DataFrame, raw_edges: DataFrame, half_life_days: float = HALF_LIFE_DAYS,
                  as_of=None, dangling: str = "drop", **options) -> tuple[DataFrame, DataFrame]:
    """The full job: raw tables -> ``(nodes, edges)``.

    ``nodes``: node metric table; ``edges``: ``src, dst`` with both ends known
    (by any of the policies).  The cleaned tables are written once, so the raw
    files are parsed once.
    """
    raw = cut(raw_edges.select("src", "dst"))      # counted and joined by both ends: several passes
    g = build_graph(raw_vertices, raw, dangling, materialize=True)
    release(raw)
    return node_metrics(g, as_of=as_of, half_life_days=half_life_days, **options), g.edges


def node_payload(nodes: DataFrame, with_last_seen: bool = True) -> DataFrame:
    """The node payload ``id, label, t, pr_percent, pr_temporal_percent``
    (plus ``last_seen``, which the detail panel shows)."""
    cols = ["id", "label", "t", "pr_percent", "pr_temporal_percent"]
    if with_last_seen and "last_seen" in nodes.columns:
        cols.append(F.col("last_seen").cast("string").alias("last_seen"))
    return nodes.select(*cols)


def top_nodes(nodes: DataFrame, k: int = 10, mode: str = "static") -> DataFrame:
    """The ``k`` highest nodes by metric, ties by id (a top-k report)."""
    m = metric_column(mode)
    return nodes.orderBy(F.col(m).desc(), F.col("id").asc()).limit(k)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(n_nodes, n_edges)`` from a single aggregate over both tables."""
    both = (nodes.select(F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(edges.select(F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return both.agg(F.sum("a").cast("long").alias("n_nodes"), F.sum("b").cast("long").alias("n_edges"))


def sqrt_scale(nodes: DataFrame, mode: str = "static", name: str = "size") -> DataFrame:
    """Node size: ``5 + 23 * sqrt(metric / max(metric))``; max 0 or empty -> 1."""
    m = metric_column(mode)
    mx = nodes.agg(F.max(to_number(m))).scalar()
    return nodes.withColumn(name, sqrt_scale_col(m, mx))
