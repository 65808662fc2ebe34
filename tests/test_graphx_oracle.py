"""Library oracle: GraphX static PageRank (shipped in the Spark jars),
called through py4j, against our DataFrame PageRank.

GraphX's edge-list loader builds the vertex set from edge ends, so the
comparison uses the edge-induced vertex set on both sides.
"""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

import entitygraph as eg
from fixtures import F1_EDGES, F2_EDGES


def graphx_pagerank(spark, edges, iterations=10, reset=0.15):
    ids = sorted({x for e in edges for x in e})
    num = {v: i for i, v in enumerate(ids)}
    path = os.path.join(tempfile.mkdtemp(prefix="eg-graphx-"), "edges.txt")
    with open(path, "w") as fh:
        fh.write("\n".join(f"{num[a]} {num[b]}" for a, b in edges) + "\n")
    jvm = spark.sparkContext._jvm
    level = jvm.org.apache.spark.storage.StorageLevel.MEMORY_ONLY()
    g = jvm.org.apache.spark.graphx.GraphLoader.edgeListFile(
        spark.sparkContext._jsc.sc(), path, False, -1, level, level)
    tag = getattr(jvm, "scala.reflect.ClassTag$").__getattr__("MODULE$").Any()
    ranks = jvm.org.apache.spark.graphx.lib.PageRank.run(g, iterations, reset, tag, tag)
    return {ids[r._1()]: r._2() for r in ranks.vertices().toJavaRDD().collect()}


def ours(spark, edges, **opts):
    e = spark.createDataFrame(list(edges), "src string, dst string")
    v = eg.vertex_universe(e.limit(0).select(F.col("src").alias("id")), e)
    return {r["id"]: r["pagerank"] for r in eg.pagerank(v, e, **opts).collect()}


@pytest.mark.parametrize("edges", [F2_EDGES, F1_EDGES], ids=["F2", "F1"])
def test_fixtures_equal_graphx(spark, edges):
    want = graphx_pagerank(spark, edges)
    got = ours(spark, edges)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-13)


def test_trade_graph_equals_graphx(spark):
    g = eg.build_graph(*eg.trade_graph(spark, "/root/testdata/sf0.001"))
    edges = [(r["src"], r["dst"]) for r in g.edges.collect()]
    want = graphx_pagerank(spark, edges)
    for opts in ({}, {"hub_out_degree": 2, "max_hubs": 100_000}):
        got = ours(spark, edges, **opts)
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-10)
