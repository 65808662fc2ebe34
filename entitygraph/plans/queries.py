"""The registered query set: one Spark callable and one DuckDB SQL text per
query name.  Spark and SQL produce the same column names and types.

Graphs: ``T`` (trade graph from customer/supplier/part/nation/region/orders/
lineitem) and ``W`` (web graph from pages); see ``sources/tables.py``.
Every query reads the whole tables; the only limits are the features
themselves (top-k, first search match).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import edge_key, normalise_type, to_number
from ..operators.clean import Graph, build_graph, dangling_edges, valid_edges, valid_vertices, vertex_universe
from ..operators.components import (component_count, component_members, component_roots, component_scores,
                                    connected_components, ranked_components, with_component_size)
from ..operators.layers import layered_components, organised_layout, seed_components
from ..operators.metrics import (as_percent, compute_graph, graph_counts, node_metrics, node_payload, recency, sqrt_scale,
                                 top_nodes)
from ..operators.pagerank import pagerank
from ..operators.search import focus, search, search_snapshot
from ..operators.subgraph import (degrees, ego_network, filter_graph, neighbour_details, neighbour_index,
                                  node_details)
from ..session import scratch_path
from ..sources.files import (export_subgraph, load_snapshot, read_edges, read_graph_json, read_graph_jsonl, read_vertices,
                             save_snapshot, write_edges, write_graph_json, write_vertices)
from ..sources.tables import HOST_PATTERN, LINK_PATTERN, trade_graph, trade_order_edges, web_graph
from . import oracle as O
from .iterate import cut

AS_OF = O.AS_OF
LONG_HALF_LIFE = 365.0
FILTER_THRESHOLD = 0.02          # static percent; no T value sits on it
TRADE_QUERY = "  Nation_7 "
WEB_QUERY = "P:0"
DATED_QUERY = " p:37 "
DATED_THRESHOLD = 0.05           # temporal percent of the dated web graph
PAGE_SEEDS = ["p:0", "p:1", "p:2", "p:3", "no such page"]


# ---------------------------------------------------------------- graphs
def _trade(spark, sf_dir, materialize=False) -> Graph:
    return build_graph(*trade_graph(spark, sf_dir, materialize), materialize=materialize)


def _web(spark, sf_dir, materialize=False) -> Graph:
    return build_graph(*web_graph(spark, sf_dir, materialize), materialize=materialize)


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _trade_metrics(spark, sf_dir, half_life=30.0):
    g = _trade(spark, sf_dir, materialize=True)
    return g, node_metrics(g, as_of=AS_OF, half_life_days=half_life)


def _web_metrics(spark, sf_dir):
    g = _web(spark, sf_dir, materialize=True)
    return g, node_metrics(g, as_of=AS_OF)


# ---------------------------------------------------------------- queries
def q_vertices(spark, d):
    return _trade(spark, d).vertices


def q_edges(spark, d):
    return _trade(spark, d).edges


def q_graph_counts(spark, d):
    g = _trade(spark, d)
    return graph_counts(g.vertices, g.edges)


def _csv_back(spark, d):
    g = _trade(spark, d)
    base = scratch_path(spark, "csv-round-trip")
    write_vertices(g.vertices, os.path.join(base, "vertices"))
    write_edges(g.edges, os.path.join(base, "edges"))
    return build_graph(read_vertices(spark, os.path.join(base, "vertices"), escaped=True),
                       read_edges(spark, os.path.join(base, "edges"), escaped=True))


def q_csv_round_trip(spark, d):
    return _csv_back(spark, d).vertices


def q_csv_edges(spark, d):
    return _csv_back(spark, d).edges


def q_csv_reordered(spark, d):
    """Columns are found by header name, in any order, and others are ignored."""
    g = _trade(spark, d)
    path = scratch_path(spark, "csv-reordered")
    (g.vertices.select("label", F.lit("ignored").alias("note"), F.col("last_seen").cast("string").alias("last_seen"), "id",
                       F.col("t").alias("type")).write.option("header", True).option("escape", '"').csv(path))
    return build_graph(read_vertices(spark, path), g.edges).vertices


def _json_back(spark, d):
    g = _web(spark, d)
    base = scratch_path(spark, "json-round-trip")
    write_graph_json(g.vertices.select("id", "label", "t"), g.edges, base)
    return read_graph_jsonl(spark, base)


def q_json_round_trip(spark, d):
    return _json_back(spark, d)[0].select("id", "label", "t")


def q_json_edges(spark, d):
    return _json_back(spark, d)[1]


def q_vertex_universe(spark, d):
    v, e = web_graph(spark, d)
    return vertex_universe(v, e)


def q_valid_edges(spark, d):
    v, e = trade_graph(spark, d, materialize=True)
    return valid_edges(e.unionByName(trade_order_edges(spark, d)), cut(valid_vertices(v)))


def q_dangling_edges(spark, d):
    v, e = trade_graph(spark, d, materialize=True)
    return dangling_edges(cut(valid_vertices(v)), e.unionByName(trade_order_edges(spark, d)))


def q_degrees(spark, d):
    g = _web(spark, d, materialize=True)
    return degrees(g.vertices, g.edges)


def q_neighbour_index(spark, d):
    return neighbour_index(_web(spark, d).edges)


def q_pagerank_percent(spark, d):
    g = _trade(spark, d, materialize=True)
    ranked = as_percent(pagerank(g.vertices, g.edges), "pagerank", "pr_percent")
    return ranked.select("id", _r6("pagerank"), "pr_percent")


def q_top_nodes(spark, d):
    _, nm = _trade_metrics(spark, d)
    return top_nodes(nm, 20).select("id", "label", "t", "pr_percent")


def q_recency_weight(spark, d):
    g = _trade(spark, d)
    return recency(g.vertices, AS_OF, LONG_HALF_LIFE).select("id", "last_seen", "age_days", _r6("recency_weight"))


def q_temporal_pagerank(spark, d):
    _, nm = _trade_metrics(spark, d, LONG_HALF_LIFE)
    return nm.select("id", _r6("pagerank_temporal"), "pr_temporal_percent")


def q_node_metrics(spark, d):
    _, nm = _trade_metrics(spark, d)
    return nm.select("id", "label", "t", "last_seen", _r6("pagerank"), "pr_percent", _r6("recency_weight"),
                     _r6("pagerank_temporal"), "pr_temporal_percent")


def q_filter_graph_nodes(spark, d):
    g, nm = _trade_metrics(spark, d)
    nodes, _ = filter_graph(nm, g.edges, "static", FILTER_THRESHOLD)
    return nodes.select("id", "label", "t", "pr_percent")


def q_filter_graph_edges(spark, d):
    g, nm = _trade_metrics(spark, d)
    _, edges = filter_graph(nm, g.edges, "static", FILTER_THRESHOLD)
    return edges


def _nation_seeds(spark, d):
    return spark.read.parquet(os.path.join(d, "nation.parquet")).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("seed"))


def q_ego_nodes(spark, d):
    g = _trade(spark, d, materialize=True)
    nodes, _ = ego_network(g.vertices, g.edges, _nation_seeds(spark, d))
    return nodes


def q_ego_edges(spark, d):
    g = _trade(spark, d, materialize=True)
    _, edges = ego_network(g.vertices, g.edges, _nation_seeds(spark, d))
    return edges


def q_node_details(spark, d):
    _, nm = _trade_metrics(spark, d)
    return node_details(nm)


def q_neighbour_details(spark, d):
    g = _trade(spark, d, materialize=True)
    return neighbour_details(g.vertices, g.edges)


def q_connected_components(spark, d):
    return with_component_size(connected_components(_web(spark, d, materialize=True)))


def q_trade_components(spark, d):
    return with_component_size(connected_components(_trade(spark, d, materialize=True)))


def q_component_of(spark, d):
    g = _web(spark, d, materialize=True)
    hosts = g.vertices.filter(F.col("t") == "host").select("id")
    return component_members(connected_components(g), hosts)


def q_component_scores(spark, d):
    g, nm = _web_metrics(spark, d)
    return ranked_components(component_scores(connected_components(g), nm))


def q_component_count(spark, d):
    return component_count(connected_components(_web(spark, d, materialize=True)))


def q_component_roots(spark, d):
    g, nm = _web_metrics(spark, d)
    return component_roots(connected_components(g), nm)


def q_bfs_layers(spark, d):
    g, nm = _web_metrics(spark, d)
    return layered_components(g, nm)


def q_organised_layout(spark, d):
    g, nm = _web_metrics(spark, d)
    return organised_layout(g, nm)


def q_search(spark, d):
    g = _trade(spark, d)
    return search(g.vertices, TRADE_QUERY).select("id", "label", "t")


def q_focus_nodes(spark, d):
    g, nm = _web_metrics(spark, d)
    nodes, _ = focus(g, nm, WEB_QUERY)
    return nodes.select("id", "label", "t", "pr_percent")


def q_focus_edges(spark, d):
    g = _web(spark, d, materialize=True)
    _, edges = focus(g, g.vertices, WEB_QUERY)
    return edges.select("src", "dst", edge_key("src", "dst").alias("key"))


def q_sqrt_scale(spark, d):
    _, nm = _trade_metrics(spark, d)
    return sqrt_scale(nm).select("id", _r6("size"))


def q_type_normalised(spark, d):
    g = _trade(spark, d)
    return g.vertices.select("id", normalise_type("t").alias("type"))


def _snapshot_back(spark, d):
    g, nm = _trade_metrics(spark, d)
    path = scratch_path(spark, "snapshot")
    save_snapshot(nm, g.edges, path)
    return load_snapshot(spark, path)


def q_snapshot_round_trip(spark, d):
    return _snapshot_back(spark, d)[0].select("id", "pr_percent", "pr_temporal_percent")


def q_snapshot_edges(spark, d):
    return _snapshot_back(spark, d)[1]


def _exported(spark, d):
    g, nm = _trade_metrics(spark, d)
    nodes, edges = filter_graph(nm, g.edges, "static", FILTER_THRESHOLD)
    path = scratch_path(spark, "export")
    export_subgraph(nodes.select("id", "label", "t", "pr_percent", "pr_temporal_percent"), edges, path)
    return path


def q_export_subgraph(spark, d):
    return spark.read.schema("source string, target string").json(os.path.join(_exported(spark, d), "links"))


def q_export_nodes(spark, d):
    return spark.read.schema("id string, label string, t string, pr_percent double, pr_temporal_percent double").json(
        os.path.join(_exported(spark, d), "nodes"))


# ---------------- the whole job on dirty files; inputs that can tell right from wrong
def _job(spark, d):
    """Raw files -> ``compute_graph``.  The trade graph as CSV, with every
    customer again under a malformed date, every supplier again under a newer
    date and a label to quote, nations without id, edges without source and
    edges to unknown orders."""
    v, e = trade_graph(spark, d, materialize=True)
    v = v.select("id", "t", "label", F.col("last_seen").cast("string").alias("last_seen"))
    none = F.lit(None).cast("string")
    v = (v.unionByName(v.filter("t = 'customer'").select("id", F.lit("dup").alias("t"), "label", F.lit("garbage").alias("last_seen")))
          .unionByName(v.filter("t = 'supplier'").select("id", "t", F.concat("label", F.lit(', "renamed"')).alias("label"),
                                                         F.lit("2002-01-01").alias("last_seen")))
          .unionByName(v.filter("t = 'nation'").withColumn("id", none)))
    e = (e.unionByName(trade_order_edges(spark, d))
          .unionByName(e.filter(F.col("src").startswith("n")).withColumn("src", none)))
    base = scratch_path(spark, "job")
    write_vertices(v, os.path.join(base, "vertices"))
    write_edges(e, os.path.join(base, "edges"))
    return compute_graph(read_vertices(spark, os.path.join(base, "vertices"), escaped=True),
                         read_edges(spark, os.path.join(base, "edges"), escaped=True),
                         half_life_days=LONG_HALF_LIFE, as_of=AS_OF)


def q_job_nodes(spark, d):
    return _job(spark, d)[0].select("id", "label", "t", "last_seen", "pr_percent", "pr_temporal_percent")


def q_job_edges(spark, d):
    return _job(spark, d)[1]


def _documents(spark, d):
    """One graph document a line and page, half of them in each alias form."""
    page = F.concat(F.lit("p:"), F.col("page_id").cast("string"))
    pages = spark.read.parquet(os.path.join(d, "pages.parquet")).select(
        "page_id", "url", page.alias("page"), F.regexp_extract("url", HOST_PATTERN, 1).alias("host"),
        F.coalesce(F.regexp_extract_all("html", F.lit(LINK_PATTERN), 1), F.array().cast("array<string>")).alias("found"))
    short, none = F.col("page_id") % 2 == 0, F.lit(None).cast("string")

    def node(i, label, t):
        return F.struct(i.alias("id"), label.alias("label"), F.when(short, F.lit(t)).alias("t"),
                        F.when(short, none).otherwise(F.lit(t)).alias("type"))

    def link(a, b):
        return F.transform("found", lambda x: F.struct(F.col("page").alias(a), F.concat(F.lit("u:"), "host", x).alias(b)))

    nodes = F.concat(F.array(node(F.col("page"), F.col("url"), "page")),
                     F.transform("found", lambda x: node(F.concat(F.lit("u:"), "host", x), F.concat("host", x), "url")))
    path = scratch_path(spark, "documents")
    pages.select(nodes.alias("nodes"), F.when(short, link("source", "target")).alias("links"),
                 F.when(~short, link("src", "dst")).alias("edges")).write.json(path)
    return read_graph_json(spark, path, lines=True)


def q_document_nodes(spark, d):
    return _documents(spark, d)[0].select("id", "label", "t")


def q_document_edges(spark, d):
    return _documents(spark, d)[1]


def _multigraph(spark, d):
    """The trade graph with one edge per ``lineitem`` row and a loop at each nation."""
    v, e = trade_graph(spark, d, materialize=True)
    sold = spark.read.parquet(os.path.join(d, "lineitem.parquet")).select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    loops = _nation_seeds(spark, d).select(F.col("seed").alias("src"), F.col("seed").alias("dst"))
    e = e.filter(~F.col("dst").startswith("p")).unionByName(sold).unionByName(loops)
    return build_graph(v, e, materialize=True)


def q_multigraph_degrees(spark, d):
    g = _multigraph(spark, d)
    return degrees(g.vertices, g.edges)


def q_multigraph_percent(spark, d):
    g = _multigraph(spark, d)
    return as_percent(pagerank(g.vertices, g.edges), "pagerank", "pr_percent").select("id", "pr_percent")


def q_temporal_filter_nodes(spark, d):
    g, nm = _trade_metrics(spark, d, LONG_HALF_LIFE)
    return filter_graph(nm, g.edges, "temporal", FILTER_THRESHOLD)[0].select("id", "pr_temporal_percent")


def q_temporal_filter_edges(spark, d):
    g, nm = _trade_metrics(spark, d, LONG_HALF_LIFE)
    return filter_graph(nm, g.edges, "temporal", FILTER_THRESHOLD)[1]


def q_temporal_top(spark, d):
    _, nm = _trade_metrics(spark, d, LONG_HALF_LIFE)
    return top_nodes(nm, 20, "temporal").select("id", "pr_temporal_percent")


def q_temporal_scale(spark, d):
    _, nm = _trade_metrics(spark, d, LONG_HALF_LIFE)
    return sqrt_scale(nm, "temporal").select("id", _r6("size"))


def q_filtered_components(spark, d):
    """Exploration of the filtered graph: threshold, then components."""
    g, nm = _trade_metrics(spark, d)
    kept, edges = filter_graph(nm, g.edges, "static", FILTER_THRESHOLD)
    return with_component_size(connected_components(Graph(cut(kept), cut(edges))))


def q_component_of_pages(spark, d):
    g = _web(spark, d, materialize=True)
    return seed_components(g, spark.createDataFrame([(s,) for s in PAGE_SEEDS], "seed string"))


def q_component_of_hosts(spark, d):
    """Walks of many seeds at once: every host."""
    g = _web(spark, d, materialize=True)
    return seed_components(g, g.vertices.filter(F.col("t") == "host").select("id"))


# ---------------- exploration in temporal mode, on the whole and the filtered graph
def _dated_web_metrics(spark, d):
    """The web graph with a day for every page (from its number), others unknown."""
    v, e = web_graph(spark, d, materialize=True)
    day = F.pmod(F.substring("id", 3, 20).cast("long") * 37, F.lit(1400)).cast("int")
    v = v.withColumn("last_seen", F.when(F.col("t") == "page", F.date_add(F.lit("1998-01-01").cast("date"), day)))
    g = build_graph(v, e, materialize=True)
    return g, node_metrics(g, as_of=AS_OF, half_life_days=LONG_HALF_LIFE)


def _filtered_web(spark, d):
    g, nm = _dated_web_metrics(spark, d)
    kept, edges = filter_graph(nm, g.edges, "temporal", DATED_THRESHOLD)
    kept = cut(kept)
    return Graph(kept, cut(edges)), kept


def q_temporal_scores(spark, d):
    g, nm = _dated_web_metrics(spark, d)
    return ranked_components(component_scores(connected_components(g), nm, "pr_temporal_percent"))


def q_temporal_roots(spark, d):
    g, nm = _dated_web_metrics(spark, d)
    return component_roots(connected_components(g), nm, "pr_temporal_percent")


def q_temporal_layers(spark, d):
    g, nm = _dated_web_metrics(spark, d)
    return layered_components(g, nm, "temporal")


def q_temporal_layout(spark, d):
    g, nm = _dated_web_metrics(spark, d)
    return organised_layout(g, nm, "temporal")


def q_filtered_layout(spark, d):
    g, kept = _filtered_web(spark, d)
    return organised_layout(g, kept, "temporal")


def q_filtered_focus_nodes(spark, d):
    g, kept = _filtered_web(spark, d)
    return focus(g, kept, DATED_QUERY)[0].select("id", "label", "pr_temporal_percent")


def q_filtered_focus_edges(spark, d):
    g, kept = _filtered_web(spark, d)
    return focus(g, kept, DATED_QUERY)[1]


# ---------------- the payload with both percents; reading a snapshot in part
def _payload_back(spark, d):
    g, nm = _trade_metrics(spark, d, LONG_HALF_LIFE)
    base = scratch_path(spark, "payload")
    write_graph_json(node_payload(nm, with_last_seen=False), g.edges, base)
    return read_graph_jsonl(spark, base)


def q_payload_nodes(spark, d):
    return _payload_back(spark, d)[0].select("id", "label", "t", "pr_percent", "pr_temporal_percent")


def q_payload_edges(spark, d):
    return _payload_back(spark, d)[1]


def _kept_snapshot(spark, d):
    g, nm = _trade_metrics(spark, d)
    path = scratch_path(spark, "snapshot")
    save_snapshot(nm, g.edges, path)
    return path


def q_snapshot_search(spark, d):
    return search_snapshot(spark, _kept_snapshot(spark, d), TRADE_QUERY).select("id", "label", "t")


def q_snapshot_filter(spark, d):
    nodes, edges = load_snapshot(spark, _kept_snapshot(spark, d))
    return filter_graph(nodes, edges, "static", FILTER_THRESHOLD)[1]


def q_type_mixed(spark, d):
    """The vocabulary in mixed case, and strangers."""
    mixed = F.create_map(*[F.lit(x) for x in ("customer", "IP", "supplier", "Domain", "part", "hash", "nation", "CERT")])
    return _trade(spark, d).vertices.select("id", normalise_type(mixed[F.col("t")]).alias("type"))


def q_number_text(spark, d):
    """Numbers and junk as text."""
    text = F.element_at(F.array(*[F.lit(x) for x in ("1.5d", "NaN", "  ", "Infinity", "x12", None)],
                                F.col("o_totalprice").cast("double").cast("string")),
                        (F.col("o_orderkey") % 7 + 1).cast("int"))
    return spark.read.parquet(os.path.join(d, "orders.parquet")).select("o_orderkey", to_number(text).alias("value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "vertices": q_vertices,
    "edges": q_edges,
    "graph_counts": q_graph_counts,
    "csv_round_trip": q_csv_round_trip,
    "csv_edges": q_csv_edges,
    "csv_reordered": q_csv_reordered,
    "json_edges": q_json_edges,
    "json_round_trip": q_json_round_trip,
    "vertex_universe": q_vertex_universe,
    "valid_edges": q_valid_edges,
    "dangling_edges": q_dangling_edges,
    "degrees": q_degrees,
    "neighbour_index": q_neighbour_index,
    "pagerank_percent": q_pagerank_percent,
    "top_nodes": q_top_nodes,
    "recency_weight": q_recency_weight,
    "temporal_pagerank": q_temporal_pagerank,
    "node_metrics": q_node_metrics,
    "filter_graph_nodes": q_filter_graph_nodes,
    "filter_graph_edges": q_filter_graph_edges,
    "ego_nodes": q_ego_nodes,
    "ego_edges": q_ego_edges,
    "node_details": q_node_details,
    "neighbour_details": q_neighbour_details,
    "connected_components": q_connected_components,
    "trade_components": q_trade_components,
    "component_of": q_component_of,
    "component_scores": q_component_scores,
    "component_count": q_component_count,
    "component_roots": q_component_roots,
    "bfs_layers": q_bfs_layers,
    "organised_layout": q_organised_layout,
    "search": q_search,
    "focus_nodes": q_focus_nodes,
    "focus_edges": q_focus_edges,
    "sqrt_scale": q_sqrt_scale,
    "type_normalised": q_type_normalised,
    "snapshot_round_trip": q_snapshot_round_trip,
    "snapshot_edges": q_snapshot_edges,
    "export_nodes": q_export_nodes,
    "export_subgraph": q_export_subgraph,
    "job_nodes": q_job_nodes,
    "job_edges": q_job_edges,
    "document_nodes": q_document_nodes,
    "document_edges": q_document_edges,
    "multigraph_degrees": q_multigraph_degrees,
    "multigraph_percent": q_multigraph_percent,
    "temporal_filter_nodes": q_temporal_filter_nodes,
    "temporal_filter_edges": q_temporal_filter_edges,
    "temporal_top": q_temporal_top,
    "temporal_scale": q_temporal_scale,
    "filtered_components": q_filtered_components,
    "component_of_pages": q_component_of_pages,
    "component_of_hosts": q_component_of_hosts,
    "temporal_scores": q_temporal_scores,
    "temporal_roots": q_temporal_roots,
    "temporal_layers": q_temporal_layers,
    "temporal_layout": q_temporal_layout,
    "filtered_layout": q_filtered_layout,
    "filtered_focus_nodes": q_filtered_focus_nodes,
    "filtered_focus_edges": q_filtered_focus_edges,
    "payload_nodes": q_payload_nodes,
    "payload_edges": q_payload_edges,
    "snapshot_search": q_snapshot_search,
    "snapshot_filter": q_snapshot_filter,
    "type_mixed": q_type_mixed,
    "number_text": q_number_text,
}


# ---------------------------------------------------------------- oracle SQL
def _t(*blocks, body):
    return O.with_ctes(O.TRADE_CTES, O.CLEAN_CTES, *blocks) + "\n" + body


def _w(*blocks, body):
    return O.with_ctes(O.WEB_CTES, O.CLEAN_CTES, *blocks) + "\n" + body


_PR = O.pagerank_ctes()
_NM30 = O.metrics_ctes(30.0)
_NM365 = O.metrics_ctes(LONG_HALF_LIFE)
_CC = O.components_ctes()
_LAY = O.layers_ctes()
_NATIONS = "(SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS seed FROM nation)"
_ORDER_EDGES = "SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 'o' || CAST(o_orderkey AS VARCHAR) AS dst FROM orders"
_R6 = "round({0}, 6) AS {0}"


def _pct_text(x):
    return f"printf('%.3f %%', CAST(round(CAST(coalesce({x}, 0.0) AS DECIMAL(18, 6)), 3) AS DOUBLE))"


_JOB = f"""
dirty_v AS (
  SELECT id, t, label, last_seen FROM raw_v
  UNION ALL SELECT id, 'dup', label, NULL FROM raw_v WHERE t = 'customer'
  UNION ALL SELECT id, t, label || ', "renamed"', DATE '2002-01-01' FROM raw_v WHERE t = 'supplier'
  UNION ALL SELECT NULL, t, label, last_seen FROM raw_v WHERE t = 'nation'),
dirty_e AS (
  SELECT src, dst FROM raw_e UNION ALL {_ORDER_EDGES}
  UNION ALL SELECT NULL, dst FROM raw_e WHERE src LIKE 'n%')"""

_MULTI = """
multi_e AS (
  SELECT src, dst FROM raw_e WHERE dst NOT LIKE 'p%'
  UNION ALL SELECT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'n' || CAST(n_nationkey AS VARCHAR) FROM nation)"""

_DEGREES = """
SELECT v.id,
       CAST(coalesce(o.oe, 0) AS BIGINT) AS out_degree, CAST(coalesce(i.ie, 0) AS BIGINT) AS in_degree,
       CAST(coalesce(o.onb, 0) AS BIGINT) AS out_neighbours, CAST(coalesce(i.inb, 0) AS BIGINT) AS in_neighbours
FROM v
LEFT JOIN (SELECT src AS id, sum(mult) AS oe, count(*) AS onb FROM pairs GROUP BY src) o ON o.id = v.id
LEFT JOIN (SELECT dst AS id, sum(mult) AS ie, count(*) AS inb FROM pairs GROUP BY dst) i ON i.id = v.id"""
_PAIRS = "pairs AS (SELECT src, dst, count(*) AS mult FROM e GROUP BY src, dst)"

_SCORES = """
sc AS (SELECT c.component, greatest(coalesce(max(nm.pr_percent), 0.0), 0.0) AS score, count(*) AS size
       FROM comp c LEFT JOIN nm ON nm.id = c.id GROUP BY c.component)"""

_LAYOUT = """
ci AS (SELECT component, row_number() OVER (ORDER BY score DESC, component) - 1 AS cidx FROM sc),
gc AS (SELECT greatest(1, ceil(sqrt(count(*)))) AS cols FROM sc),
gw AS (SELECT cols, greatest(260.0, 1200.0 / cols) AS cw FROM gc),
cells AS (SELECT ci.component, (ci.cidx % gw.cols) * gw.cw + gw.cw / 2 AS cx,
                 floor(ci.cidx / gw.cols) * 220.0 + 130.0 AS cy FROM ci, gw),
sl AS (
  SELECT lay.component, lay.id, lay.layer,
         row_number() OVER (PARTITION BY lay.component, lay.layer
                            ORDER BY coalesce(nm.pr_percent, 0.0) DESC, lay.id) - 1 AS slot,
         count(*) OVER (PARTITION BY lay.component, lay.layer) AS k
  FROM lay LEFT JOIN nm ON nm.id = lay.id
)"""

_DATED = """
dated_v AS (SELECT id, t, label, CASE WHEN t = 'page' THEN DATE '1998-01-01'
              + CAST((CAST(substr(id, 3) AS BIGINT) * 37) % 1400 AS INTEGER) END AS last_seen FROM raw_v)"""
_TEMPORAL = [b.replace("pr_percent", "pr_temporal_percent") for b in (_SCORES, _LAYOUT)]
_TLAY = O.layers_ctes(metric="pr_temporal_percent")
_KEPT = f"""
kept_v AS (SELECT * FROM nm WHERE pr_temporal_percent >= {DATED_THRESHOLD!r}),
kept_e AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM kept_v) AND dst IN (SELECT id FROM kept_v))"""
_KEPT_CC = O.components_ctes("kept_v", "kept_e")
_FOUND = f"""
hit AS (SELECT id FROM kept_v WHERE lower(id) = '{DATED_QUERY.strip().lower()}'
        OR lower(coalesce(label, '')) = '{DATED_QUERY.strip().lower()}' ORDER BY id LIMIT 1),
fc AS (SELECT c.id FROM comp c WHERE c.component IN (SELECT component FROM comp JOIN hit USING (id)))"""
_PLACES = """
SELECT sl.component, sl.id, sl.layer, CAST(sl.slot AS INTEGER) AS slot,
       round(c.cx + CASE WHEN sl.layer = 0 THEN 0.0
             ELSE sl.layer * 42.0 * cos((2 * pi()) * sl.slot / greatest(sl.k, 1)) END, 3) AS x,
       round(c.cy + CASE WHEN sl.layer = 0 THEN 0.0
             ELSE sl.layer * 42.0 * sin((2 * pi()) * sl.slot / greatest(sl.k, 1)) END, 3) AS y
FROM sl JOIN cells c ON c.component = sl.component"""


def _dated(*blocks, body):
    return O.with_ctes(O.WEB_CTES, _DATED, O.clean_ctes("dated_v", "raw_e"), _PR, _NM365, *blocks) + "\n" + body


ORACLE: dict[str, str] = {
    "vertices": _t(body="SELECT id, t, label, last_seen FROM v"),
    "edges": _t(body="SELECT src, dst FROM e"),
    "graph_counts": _t(body="SELECT (SELECT count(*) FROM v) AS n_nodes, (SELECT count(*) FROM e) AS n_edges"),
    "csv_round_trip": _t(body="SELECT id, t, label, last_seen FROM v"),
    "csv_edges": _t(body="SELECT src, dst FROM e"),
    "csv_reordered": _t(body="SELECT id, t, label, last_seen FROM v"),
    "json_edges": _w(body="SELECT src, dst FROM e"),
    "json_round_trip": _w(body="SELECT id, label, t FROM v"),
    "vertex_universe": O.with_ctes(O.WEB_CTES) + """
SELECT DISTINCT id FROM (SELECT id FROM raw_v UNION ALL SELECT src FROM raw_e UNION ALL SELECT dst FROM raw_e)
WHERE id IS NOT NULL""",
    "valid_edges": _t(f"all_e AS (SELECT src, dst FROM raw_e UNION ALL {_ORDER_EDGES})", body="""
SELECT src, dst FROM all_e WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)"""),
    "dangling_edges": _t(f"all_e AS (SELECT src, dst FROM raw_e UNION ALL {_ORDER_EDGES})", body="""
SELECT src, dst FROM all_e WHERE src NOT IN (SELECT id FROM v)
UNION ALL SELECT src, dst FROM all_e WHERE src IN (SELECT id FROM v) AND dst NOT IN (SELECT id FROM v)"""),
    "degrees": _w(_PAIRS, body=_DEGREES),
    "neighbour_index": _w("pairs AS (SELECT DISTINCT src, dst FROM e)", body="""
SELECT src AS id, dst AS nbr, 'out' AS direction FROM pairs
UNION ALL SELECT dst, src, 'in' FROM pairs"""),
    "pagerank_percent": _t(_PR, body=f"""
SELECT id, {_R6.format('pagerank')},
       round(pagerank / (SELECT sum(pagerank) FROM pr) * 100.0, 6) AS pr_percent FROM pr"""),
    "top_nodes": _t(_PR, _NM30, body="""
SELECT id, label, t, pr_percent FROM nm ORDER BY pr_percent DESC, id LIMIT 20"""),
    "recency_weight": _t(body=f"""
SELECT id, last_seen, CAST(date_diff('day', last_seen, DATE '{AS_OF}') AS INTEGER) AS age_days,
       round(CASE WHEN last_seen IS NULL THEN 1.0
             ELSE power(0.5, CAST(date_diff('day', last_seen, DATE '{AS_OF}') AS DOUBLE) / {LONG_HALF_LIFE!r}) END, 6)
         AS recency_weight
FROM v"""),
    "temporal_pagerank": _t(_PR, _NM365, body=f"""
SELECT id, {_R6.format('pagerank_temporal')}, pr_temporal_percent FROM nm"""),
    "node_metrics": _t(_PR, _NM30, body=f"""
SELECT id, label, t, last_seen, {_R6.format('pagerank')}, pr_percent, {_R6.format('recency_weight')},
       {_R6.format('pagerank_temporal')}, pr_temporal_percent FROM nm"""),
    "filter_graph_nodes": _t(_PR, _NM30, body=f"""
SELECT id, label, t, pr_percent FROM nm WHERE pr_percent >= {FILTER_THRESHOLD!r}"""),
    "filter_graph_edges": _t(_PR, _NM30, f"kept AS (SELECT id FROM nm WHERE pr_percent >= {FILTER_THRESHOLD!r})",
                             body="""
SELECT src, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)"""),
    "ego_nodes": _t(f"s AS (SELECT seed FROM {_NATIONS} WHERE seed IN (SELECT id FROM v))", body="""
SELECT DISTINCT seed, id FROM (
  SELECT seed, seed AS id FROM s
  UNION ALL SELECT s.seed, e.dst FROM e JOIN s ON e.src = s.seed
  UNION ALL SELECT s.seed, e.src FROM e JOIN s ON e.dst = s.seed)"""),
    "ego_edges": _t(f"s AS (SELECT seed FROM {_NATIONS} WHERE seed IN (SELECT id FROM v))", body="""
SELECT s.seed, e.src, e.dst FROM e JOIN s ON e.src = s.seed
UNION ALL SELECT s.seed, e.src, e.dst FROM e JOIN s ON e.dst = s.seed WHERE e.src <> e.dst"""),
    "node_details": _t(_PR, _NM30, body=f"""
SELECT id, coalesce(nullif(label, ''), id) AS title, coalesce(nullif(t, ''), '-') AS type,
       coalesce(nullif(label, ''), id) AS label,
       {_pct_text('pr_percent')} AS pr_text, {_pct_text('pr_temporal_percent')} AS pr_temporal_text,
       coalesce(nullif(CAST(last_seen AS VARCHAR), ''), '-') AS last_seen
FROM nm"""),
    "neighbour_details": _t("pairs AS (SELECT DISTINCT src, dst FROM e)", body="""
SELECT x.id, x.direction, x.nbr, coalesce(nullif(v.label, ''), v.id) AS nbr_label,
       coalesce(nullif(lower(v.t), ''), '-') AS nbr_type
FROM (SELECT src AS id, 'out' AS direction, dst AS nbr FROM pairs
      UNION ALL SELECT dst, 'in', src FROM pairs) x
JOIN v ON v.id = x.nbr"""),
    "connected_components": _w(_CC, body="""
SELECT id, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp"""),
    # T's diameter is at most 6 (part-supplier-nation-region-nation-supplier-part)
    "trade_components": _t(O.label_propagation_ctes(10), body="""
SELECT id, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp"""),
    "component_of": _w(_CC, body="""
SELECT c.component, c.id FROM comp c
WHERE c.component IN (SELECT s.component FROM comp s JOIN v ON v.id = s.id WHERE v.t = 'host')"""),
    "component_scores": _w(_PR, _NM30, _CC, _SCORES, body="""
SELECT component, score, size, row_number() OVER (ORDER BY score DESC, component) - 1 AS rank FROM sc"""),
    "component_count": _w(_CC, body="SELECT count(DISTINCT component) AS n_components FROM comp"),
    "component_roots": _w(_PR, _NM30, _CC, _LAY, body="SELECT component, root FROM roots"),
    "bfs_layers": _w(_PR, _NM30, _CC, _LAY, body="SELECT component, id, root, layer FROM lay"),
    "organised_layout": _w(_PR, _NM30, _CC, _LAY, _SCORES, _LAYOUT, body=_PLACES),
    "search": _t(body=f"""
SELECT id, label, t FROM v
WHERE lower(coalesce(id, '')) = '{TRADE_QUERY.strip().lower()}' OR lower(coalesce(label, '')) = '{TRADE_QUERY.strip().lower()}'
ORDER BY id LIMIT 1"""),
    "focus_nodes": _w(_PR, _NM30, _CC, f"""
hit AS (SELECT id FROM v WHERE lower(coalesce(id, '')) = '{WEB_QUERY.strip().lower()}'
        OR lower(coalesce(label, '')) = '{WEB_QUERY.strip().lower()}' ORDER BY id LIMIT 1),
fc AS (SELECT c.id FROM comp c WHERE c.component IN (SELECT component FROM comp JOIN hit USING (id)))""",
                      body="SELECT id, label, t, pr_percent FROM nm WHERE id IN (SELECT id FROM fc)"),
    "focus_edges": _w(_CC, f"""
hit AS (SELECT id FROM v WHERE lower(coalesce(id, '')) = '{WEB_QUERY.strip().lower()}'
        OR lower(coalesce(label, '')) = '{WEB_QUERY.strip().lower()}' ORDER BY id LIMIT 1),
fc AS (SELECT c.id FROM comp c WHERE c.component IN (SELECT component FROM comp JOIN hit USING (id)))""",
                      body="""
SELECT src, dst, src || '->' || dst AS key FROM e WHERE src IN (SELECT id FROM fc) AND dst IN (SELECT id FROM fc)"""),
    "sqrt_scale": _t(_PR, _NM30, body="""
SELECT id, round(5.0 + 23.0 * sqrt(pr_percent / coalesce(nullif((SELECT max(pr_percent) FROM nm), 0.0), 1.0)), 6)
  AS size FROM nm"""),
    "type_normalised": _t(body="""
SELECT id, CASE WHEN lower(t) IN ('domain', 'ip', 'cert', 'hash') THEN lower(t) ELSE 'other' END AS type FROM v"""),
    "snapshot_round_trip": _t(_PR, _NM30, body="SELECT id, pr_percent, pr_temporal_percent FROM nm"),
    "snapshot_edges": _t(body="SELECT src, dst FROM e"),
    "export_nodes": _t(_PR, _NM30, body=f"SELECT id, label, t, pr_percent, pr_temporal_percent FROM nm WHERE pr_percent >= {FILTER_THRESHOLD!r}"),
    "export_subgraph": _t(_PR, _NM30, f"kept AS (SELECT id FROM nm WHERE pr_percent >= {FILTER_THRESHOLD!r})",
                          body="""
SELECT src AS source, dst AS target FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)"""),
    "job_nodes": O.with_ctes(O.TRADE_CTES, _JOB, O.clean_ctes("dirty_v", "dirty_e"), _PR, _NM365) + """
SELECT id, label, t, last_seen, pr_percent, pr_temporal_percent FROM nm""",
    "job_edges": O.with_ctes(O.TRADE_CTES, _JOB, O.clean_ctes("dirty_v", "dirty_e")) + "\nSELECT src, dst FROM e",
    "document_nodes": O.with_ctes(O.WEB_CTES) + """
SELECT 'p:' || CAST(page_id AS VARCHAR) AS id, url AS label, 'page' AS t FROM pg
UNION ALL SELECT 'u:' || host || link, host || link, 'url' FROM lk""",
    "document_edges": O.with_ctes(O.WEB_CTES) + "\nSELECT page AS src, 'u:' || host || link AS dst FROM lk",
    "multigraph_degrees": O.with_ctes(O.TRADE_CTES, _MULTI, O.clean_ctes("raw_v", "multi_e"), _PAIRS) + _DEGREES,
    "multigraph_percent": O.with_ctes(O.TRADE_CTES, _MULTI, O.clean_ctes("raw_v", "multi_e"), _PR) + """
SELECT id, round(pagerank / (SELECT sum(pagerank) FROM pr) * 100.0, 6) AS pr_percent FROM pr""",
    "temporal_filter_nodes": _t(_PR, _NM365, body=f"""
SELECT id, pr_temporal_percent FROM nm WHERE pr_temporal_percent >= {FILTER_THRESHOLD!r}"""),
    "temporal_filter_edges": _t(_PR, _NM365, f"kept AS (SELECT id FROM nm WHERE pr_temporal_percent >= {FILTER_THRESHOLD!r})",
                                body="""
SELECT src, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)"""),
    "temporal_top": _t(_PR, _NM365, body="""
SELECT id, pr_temporal_percent FROM nm ORDER BY pr_temporal_percent DESC, id LIMIT 20"""),
    "temporal_scale": _t(_PR, _NM365, body="""
SELECT id, round(5.0 + 23.0 * sqrt(pr_temporal_percent / coalesce(nullif((SELECT max(pr_temporal_percent) FROM nm), 0.0), 1.0)), 6)
  AS size FROM nm"""),
    "filtered_components": _t(_PR, _NM30, f"kept AS (SELECT id FROM nm WHERE pr_percent >= {FILTER_THRESHOLD!r})",
                              "kept_e AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept))",
                              O.label_propagation_ctes(10, "kept", "kept_e"), body="""
SELECT id, component, count(*) OVER (PARTITION BY component) AS component_size FROM comp"""),
    "component_of_pages": _w(_CC, body=f"""
SELECT c.component, c.id FROM comp c
WHERE c.component IN (SELECT component FROM comp WHERE id IN ({", ".join(f"'{s}'" for s in PAGE_SEEDS)}))"""),
    "component_of_hosts": _w(_CC, body="""
SELECT c.component, c.id FROM comp c
WHERE c.component IN (SELECT s.component FROM comp s JOIN v ON v.id = s.id WHERE v.t = 'host')"""),
    "temporal_scores": _dated(_CC, _TEMPORAL[0], body="""
SELECT component, score, size, row_number() OVER (ORDER BY score DESC, component) - 1 AS rank FROM sc"""),
    "temporal_roots": _dated(_CC, _TLAY, body="SELECT component, root FROM roots"),
    "temporal_layers": _dated(_CC, _TLAY, body="SELECT component, id, root, layer FROM lay"),
    "temporal_layout": _dated(_CC, _TLAY, *_TEMPORAL, body=_PLACES),
    "filtered_layout": _dated(_KEPT, _KEPT_CC, _TLAY, *_TEMPORAL, body=_PLACES),
    "filtered_focus_nodes": _dated(_KEPT, _KEPT_CC, _FOUND, body="""
SELECT id, label, pr_temporal_percent FROM kept_v WHERE id IN (SELECT id FROM fc)"""),
    "filtered_focus_edges": _dated(_KEPT, _KEPT_CC, _FOUND, body="""
SELECT src, dst FROM kept_e WHERE src IN (SELECT id FROM fc) AND dst IN (SELECT id FROM fc)"""),
    "payload_nodes": _t(_PR, _NM365, body="SELECT id, label, t, pr_percent, pr_temporal_percent FROM nm"),
    "payload_edges": _t(body="SELECT src, dst FROM e"),
    "snapshot_search": _t(body=f"""
SELECT id, label, t FROM v
WHERE lower(coalesce(id, '')) = '{TRADE_QUERY.strip().lower()}' OR lower(coalesce(label, '')) = '{TRADE_QUERY.strip().lower()}'
ORDER BY id LIMIT 1"""),
    "snapshot_filter": _t(_PR, _NM30, f"kept AS (SELECT id FROM nm WHERE pr_percent >= {FILTER_THRESHOLD!r})", body="""
SELECT src, dst FROM e WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)"""),
    "type_mixed": _t(body="""
SELECT id, CASE t WHEN 'customer' THEN 'ip' WHEN 'supplier' THEN 'domain' WHEN 'part' THEN 'hash' WHEN 'nation' THEN 'cert'
  ELSE 'other' END AS type FROM v"""),
    "number_text": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN CAST(o_totalprice AS DOUBLE) ELSE 0.0::DOUBLE END AS value FROM orders""",
}
