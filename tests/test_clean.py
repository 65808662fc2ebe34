import datetime as dt

import pytest
from pyspark.sql import functions as F

import entitygraph as eg
from fixtures import F4_EDGES, F4_VERTICES, F4_WEIGHT, graph


def _f4(spark):
    v = spark.createDataFrame(F4_VERTICES, "id string, type string, label string, last_seen string")
    e = spark.createDataFrame(F4_EDGES, "src string, dst string")
    return v, e


def test_vertices_dedupe_and_dates(spark):
    v, e = _f4(spark)
    rows = {r["id"]: r for r in eg.valid_vertices(v).collect()}
    assert set(rows) == {"a", "b", "c", "d", "e"}            # null id dropped
    assert rows["a"]["label"] == "1.1.1.1"                    # newer duplicate wins
    assert rows["c"]["last_seen"] is None                     # malformed date -> null
    assert rows["d"]["last_seen"] == dt.date(2024, 3, 1)      # month-only date
    assert rows["b"]["t"] is None


def test_recency_weights(spark):
    v, e = _f4(spark)
    g = eg.build_graph(v, e)
    w = {r["id"]: r for r in eg.recency(g.vertices, "2024-04-01", 30.0).collect()}
    for k, want in F4_WEIGHT.items():
        assert w[k]["recency_weight"] == pytest.approx(want, rel=1e-12), k
    assert w["a"]["age_days"] == 31 and w["e"]["age_days"] == -2101
    clamped = {r["id"]: r["recency_weight"] for r in eg.recency(g.vertices, "2024-04-01", 30.0, True).collect()}
    assert clamped["e"] == 1.0 and clamped["a"] == pytest.approx(F4_WEIGHT["a"])


def test_dangling_policies(spark):
    v, e = _f4(spark)
    g = eg.build_graph(v, e, "drop")
    edges = sorted((r["src"], r["dst"]) for r in g.edges.collect())
    assert edges == [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")]   # parallel + self-loop kept
    k = eg.build_graph(v, e, "keep")
    assert "ghost" in {r["id"] for r in k.vertices.collect()}
    assert k.edges.count() == 6
    with pytest.raises(ValueError):
        eg.build_graph(v, e, "error")
    assert eg.pagerank(k.vertices, k.edges).count() == 6


def test_vertex_universe_and_dangling(spark):
    v, e = _f4(spark)
    ids = {r["id"] for r in eg.vertex_universe(v, e).collect()}
    assert ids == {"a", "b", "c", "d", "e", "ghost"}
    bad = [(r["src"], r["dst"]) for r in eg.dangling_edges(eg.valid_vertices(v), e).collect()]
    assert bad == [("a", "ghost")]


def test_node_metrics_f4(spark):
    v, e = _f4(spark)
    g = eg.build_graph(v, e)
    nm = {r["id"]: r for r in eg.node_metrics(g, as_of="2024-04-01").collect()}
    assert set(nm) == {"a", "b", "c", "d", "e"}
    assert sum(r["pr_percent"] for r in nm.values()) == pytest.approx(100.0, abs=1e-5)
    # the future vertex dominates the temporal ranking (no clamp)
    assert nm["e"]["pr_temporal_percent"] == pytest.approx(100.0, abs=1e-5)
    big_half_life = {r["id"]: r for r in eg.node_metrics(g, as_of="2024-04-01", half_life_days=1e12).collect()}
    for r in big_half_life.values():
        assert r["pr_temporal_percent"] == pytest.approx(r["pr_percent"], abs=1e-6)


def test_materialized_graph_same_rows(spark):
    rv, re_ = eg.trade_graph(spark, "/root/testdata/sf0.001", materialize=True)
    a = eg.build_graph(rv, re_)
    b = eg.build_graph(rv, re_, materialize=True)
    assert sorted(a.vertices.collect()) == sorted(b.vertices.collect())
    assert sorted(a.edges.collect()) == sorted(b.edges.collect())


def test_full_job_reads_raw_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    v, e = graph(spark, ["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "ghost"), (None, "a")])
    nodes, edges = eg.compute_graph(v, e.mapInPandas(count, "src string, dst string"), as_of="2024-01-01")
    assert sorted(map(tuple, edges.collect())) == [("a", "b"), ("b", "c")] and nodes.count() == 3
    assert seen.value == 4
