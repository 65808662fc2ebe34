"""The at-scale code paths (salted hub sources, hub-split joins, salted
adjacency) forced on real derived graphs give the same answers as the
default (small-graph) paths."""

import pytest

import entitygraph as eg

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def trade(spark):
    return eg.build_graph(*eg.trade_graph(spark, SF, materialize=True), materialize=True)


@pytest.fixture(scope="module")
def web(spark):
    return eg.build_graph(*eg.web_graph(spark, SF), materialize=True)


def test_pagerank_salted_equals_plain(trade):
    base = {r["id"]: r["pagerank"] for r in eg.pagerank(trade.vertices, trade.edges).collect()}
    # every supplier with more than 3 parts is split over several salts
    salted = {r["id"]: r["pagerank"] for r in eg.pagerank(
        trade.vertices, trade.edges, hub_out_degree=3, max_hubs=10_000).collect()}
    assert base.keys() == salted.keys()
    for k, v in base.items():
        assert salted[k] == pytest.approx(v, rel=1e-12)


def test_components_hub_split_equals_plain(trade, web):
    for g in (trade, web):
        plain = {r["id"]: r["component"] for r in eg.connected_components(g).collect()}
        hubs = {r["id"]: r["component"] for r in eg.connected_components(g, hub_degree=2, max_hubs=1_000_000).collect()}
        assert plain == hubs


def test_bfs_salted_adjacency_equals_plain(web):
    nm = eg.node_metrics(web, as_of="2001-12-31")
    cc = eg.connected_components(web)
    roots = eg.component_roots(cc, nm)
    a = sorted(eg.bfs_layers(web, roots).collect())
    c = sorted(eg.bfs_layers(web, roots, small_edges=0, hub_degree=2, max_hubs=1_000_000).collect())
    d = sorted(eg.bfs_layers(web, roots, small_edges=0, hub_degree=3, max_hubs=1_000_000).collect())
    assert a == c == d and len(a) == web.vertices.count()


def test_layers_respect_bfs_property(web):
    """Across every undirected edge the layers differ by at most one."""
    from pyspark.sql import functions as F
    nm = eg.node_metrics(web, as_of="2001-12-31")
    lay = eg.layered_components(web, nm).select("id", "layer")
    e = web.edges.join(lay.withColumnRenamed("id", "src").withColumnRenamed("layer", "ls"), "src") \
                 .join(lay.withColumnRenamed("id", "dst").withColumnRenamed("layer", "ld"), "dst")
    assert e.filter(F.abs(F.col("ls") - F.col("ld")) > 1).count() == 0


def test_component_is_min_over_neighbours(trade):
    """A component label equals the smallest label among the vertex and its neighbours."""
    from pyspark.sql import functions as F
    cc = eg.connected_components(trade)
    e = trade.edges.join(cc.withColumnRenamed("id", "src").withColumnRenamed("component", "cs"), "src") \
                   .join(cc.withColumnRenamed("id", "dst").withColumnRenamed("component", "cd"), "dst")
    assert e.filter(F.col("cs") != F.col("cd")).count() == 0
    bad = cc.filter(F.col("component") > F.col("id")).count()
    assert bad == 0
