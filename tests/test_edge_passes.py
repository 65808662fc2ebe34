"""Large edge tables are shuffled as seldom as the job allows, and nothing as
large as the vertices goes through the driver."""

import importlib
from collections import Counter

import pytest

import entitygraph as eg
from entitygraph.plans import iterate
from fixtures import graph

pr = importlib.import_module("entitygraph.operators.pagerank")
cc = importlib.import_module("entitygraph.operators.components")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_edges_of_vertices_without_in_edges_are_sent_once(spark, monkeypatch):
    """Only what a moving vertex sends is stored for the later rounds."""
    stored = []
    plain = pr.bucketed
    monkeypatch.setattr(pr, "bucketed", lambda df, *a, **k: stored.append(sorted(tuple(r) for r in df.collect())) or plain(df, *a, **k))
    edges = [(f"s{i}", f"p{i * j % 7}") for i in range(9) for j in range(5)] + [(f"s{i}", "n") for i in range(9)]
    edges += [("n", "r"), ("n", "r")]
    ids = sorted({x for e in edges for x in e} | {"alone"})
    g = eg.build_graph(*graph(spark, ids, edges))
    out = Counter(a for a, _ in edges)
    want = dict.fromkeys(ids, 1.0)
    for _ in range(10):
        got = dict.fromkeys(ids, 0.0)
        for a, b in edges:
            got[b] += want[a] / out[a]
        want = {i: 0.15 + 0.85 * got[i] for i in ids}
    for opts in ({}, {"max_hubs": 0}):       # the senders broadcast, the senders shuffled
        stored.clear()
        ranks = eg.pagerank(g.vertices, g.edges, raw=True, **opts)
        assert {r["id"]: r["raw_rank"] for r in ranks.collect()} == pytest.approx(want, rel=1e-12)
        assert stored == [[("n", 0, "r", 2)]]


def test_few_written_ids_go_to_the_edges(spark, monkeypatch):
    """No edge is counted or shuffled for them; ids that may repeat or be null multiply nothing."""
    monkeypatch.setattr(iterate, "HOT_ROWS", 100)
    rows = [(f"a{i % 20}", f"a{i % 13}") for i in range(400)] + [(None, "a1"), ("a1", None)]
    edges = iterate.cut(spark.createDataFrame(rows, "src string, dst string"))
    kept = spark.createDataFrame([("a1",), ("a1",), ("a2",), ("a3",), (None,)], "id string")
    few = eg.induced_edges(edges, kept)
    assert "__salts" not in _plan(few) and "BroadcastHashJoin" in _plan(few)
    want = Counter((a, b) for a, b in rows if {a, b} <= {"a1", "a2", "a3"})
    assert Counter(tuple(r) for r in few.collect()) == want
    many = eg.induced_edges(edges, spark.createDataFrame([(f"a{i}",) for i in range(1, 12)], "id string"))
    assert "__salts" in _plan(many)


def test_rounds_of_components_send_no_vertices_to_the_driver(spark, monkeypatch):
    """Beyond MAX_SENT edges every join of a round is shuffled; the labels agree."""
    plans = []
    plain = cc.cut
    monkeypatch.setattr(cc, "cut", lambda df: plans.append(_plan(df)) or plain(df))
    nodes = [f"v{i:03d}" for i in range(60)]
    edges = list(zip(nodes[:40], nodes[1:40])) + [("v000", n) for n in nodes[45:60]]
    g = eg.build_graph(*graph(spark, nodes, edges), materialize=True)
    want = {n: "v000" if n < "v040" or n >= "v045" else n for n in nodes}
    monkeypatch.setattr(cc, "MAX_SENT", 0)
    for opts in ({}, {"hub_degree": 5, "max_hubs": 100}):
        plans.clear()
        got = {r["id"]: r["component"] for r in eg.connected_components(g, **opts).collect()}
        assert got == want
        joins = [p for p in plans if "Join" in p]
        assert joins and all("SortMergeJoin" in p for p in joins)
        assert opts or not any("BroadcastHashJoin" in p for p in joins)
