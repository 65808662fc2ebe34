import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

import entitygraph as eg
from fixtures import F1_EDGES, F1_NODES, F4_EDGES, F4_VERTICES, graph


def _tmp():
    return tempfile.mkdtemp(prefix="eg-io-")


def test_csv_round_trip(spark):
    d = _tmp()
    with open(os.path.join(d, "vertices.csv"), "w") as fh:
        fh.write("id,type,label,last_seen\n")
        for row in F4_VERTICES:
            fh.write(",".join("" if x is None else x for x in row) + "\n")
    with open(os.path.join(d, "edges.csv"), "w") as fh:
        fh.write("src,dst\n")
        for a, b in F4_EDGES:
            fh.write(f"{a or ''},{b or ''}\n")
    v = eg.read_vertices(spark, os.path.join(d, "vertices.csv"))
    e = eg.read_edges(spark, os.path.join(d, "edges.csv"))
    assert v.columns == ["id", "t", "label", "last_seen"]
    g = eg.build_graph(v, e)
    assert g.vertices.count() == 5 and g.edges.count() == 5
    out = os.path.join(d, "out")
    eg.write_vertices(g.vertices, os.path.join(out, "v"))
    eg.write_edges(g.edges, os.path.join(out, "e"))
    back = eg.build_graph(eg.read_vertices(spark, os.path.join(out, "v")), eg.read_edges(spark, os.path.join(out, "e")))
    assert sorted(back.vertices.collect()) == sorted(g.vertices.collect())
    assert sorted(back.edges.collect()) == sorted(g.edges.collect())


@pytest.mark.parametrize("form", ["links", "edges"])
def test_graph_document_both_alias_forms(spark, form):
    d = _tmp()
    nodes = [{"id": i, "label": l, "t": t, "pr_percent": 1.5, "pr_temporal_percent": "junk"} for i, l, t in F1_NODES]
    if form == "links":
        doc = {"nodes": nodes, "links": [{"source": a, "target": b} for a, b in F1_EDGES]}
    else:
        doc = {"nodes": nodes, "edges": [{"src": a, "dst": b} for a, b in F1_EDGES]}
    with open(os.path.join(d, "graph.json"), "w") as fh:
        json.dump(doc, fh, indent=2)
    n, e = eg.read_graph_json(spark, os.path.join(d, "graph.json"))
    assert n.count() == 34 and e.count() == 34
    assert e.filter(F.col("src").isNull() | F.col("dst").isNull()).count() == 0
    vals = n.select(eg.to_number("pr_percent").alias("a"), eg.to_number("pr_temporal_percent").alias("b")).first()
    assert (vals["a"], vals["b"]) == (1.5, 0.0)


def test_snapshot_and_export(spark):
    v, e = graph(spark, F1_NODES, F1_EDGES)
    nodes, edges = eg.compute_graph(v, e, as_of="2024-01-01")
    d = _tmp()
    with pytest.raises(FileNotFoundError):
        eg.load_snapshot(spark, os.path.join(d, "missing"))
    eg.save_snapshot(nodes, edges, os.path.join(d, "snap"))
    n2, e2 = eg.load_snapshot(spark, os.path.join(d, "snap"))
    assert n2.count() == 34 and e2.count() == 34
    kept, kept_e = eg.filter_graph(n2, e2, "static", 2.7)
    eg.export_subgraph(kept, kept_e, os.path.join(d, "doc"))
    links = spark.read.json(os.path.join(d, "doc", "links"))
    assert set(links.columns) == {"source", "target"} and links.count() == kept_e.count()
    assert spark.read.json(os.path.join(d, "doc", "nodes")).count() == kept.count()
    eg.write_graph_json(n2, e2, os.path.join(d, "jl"))
    from entitygraph.sources.files import read_graph_jsonl
    n3, e3 = read_graph_jsonl(spark, os.path.join(d, "jl"))
    assert n3.count() == 34 and e3.count() == 34


@pytest.fixture(scope="module")
def f1m(spark):
    v, e = graph(spark, F1_NODES, F1_EDGES)
    g = eg.build_graph(v, e, materialize=True)
    return g, eg.node_metrics(g, as_of="2024-01-01")


def test_filter_graph_inclusive(spark, f1m):
    g, nm = f1m
    kept, edges = eg.filter_graph(nm, g.edges, "static", 2.865622)
    ids = {r["id"] for r in kept.collect()}
    assert "a6" in ids and "a3" not in ids            # inclusive threshold
    for r in edges.collect():
        assert r["src"] in ids and r["dst"] in ids
    all_nodes, all_edges = eg.filter_graph(nm, g.edges, "unknown-mode", 0)
    assert all_nodes.count() == 34 and all_edges.count() == 34


def test_ego_network(spark, f1m):
    g, _ = f1m
    nodes, edges = eg.ego_network(g.vertices, g.edges, "a8")
    assert {r["id"] for r in nodes.collect()} == {"a8", "d_elm", "h3", "h9"}
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [
        ("d_elm", "a8"), ("h3", "a8"), ("h9", "a8")]
    n2, _ = eg.ego_network(g.vertices, g.edges, ["a8", "nope"])
    assert n2.count() == 4


def test_degrees_and_neighbours(spark, f1m):
    g, nm = f1m
    d = {r["id"]: r for r in eg.degrees(g.vertices, g.edges).collect()}
    assert (d["d_alder"]["out_degree"], d["d_alder"]["in_degree"]) == (6, 0)
    assert d["a8"]["in_neighbours"] == 3 and d["h99"]["out_degree"] == 0
    det = eg.neighbour_details(nm, g.edges).filter("id = 'h3'").collect()
    assert sorted((r["direction"], r["nbr"], r["nbr_type"]) for r in det) == [
        ("in", "d_birch", "domain"), ("out", "a8", "ip")]
    nd = {r["id"]: r for r in eg.node_details(nm).collect()}
    assert nd["a8"]["pr_text"] == "6.471 %" and nd["a8"]["last_seen"] == "-"
    assert nd["a8"]["title"] == "10.20.0.8"


def test_search_and_focus(spark, f1m):
    g, nm = f1m
    assert eg.search(nm, "  BIRCH.TEST ").first()["id"] == "d_birch"
    assert eg.search(nm, "   ").count() == 0
    assert eg.search(nm, "no-such").count() == 0
    nodes, edges = eg.focus(g, nm, "cn=tree-9")
    assert {r["id"] for r in nodes.collect()} == {"d_fir", "a20", "a21", "c9", "h20", "h21"}
    assert edges.count() == 5
    n0, e0 = eg.focus(g, nm, "nothing")
    assert n0.count() == 0 and e0.count() == 0


def test_scalar_functions(spark, f1m):
    g, nm = f1m
    sized = {r["id"]: r["size"] for r in eg.sqrt_scale(nm).collect()}
    assert sized["a8"] == pytest.approx(28.0) and min(sized.values()) > 5.0
    df = spark.createDataFrame([("IP",), ("Domain",), ("thing",), (None,)], "t string")
    assert [r[0] for r in df.select(eg.normalise_type("t")).collect()] == ["ip", "domain", "other", "other"]
    nums = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), (None,), ("x",)], "v string")
    assert [r[0] for r in nums.select(eg.to_number("v")).collect()] == [1.5, 0.0, 0.0, 0.0, 0.0]
    assert eg.metric_column("temporal") == "pr_temporal_percent" and eg.metric_column("x") == "pr_percent"


def test_csv_by_header_name(spark):
    d = _tmp()
    with open(os.path.join(d, "v.csv"), "w") as fh:
        fh.write("label,id,extra,last_seen,t\n\"say \"\"hi\"\", a\",x,1,2024-03-01,ip\n")
    with open(os.path.join(d, "e.csv"), "w") as fh:
        fh.write("dst,note,src\ny,n,x\n")
    assert [tuple(r) for r in eg.read_vertices(spark, os.path.join(d, "v.csv")).collect()] == [
        ("x", "ip", 'say "hi", a', "2024-03-01")]
    assert [tuple(r) for r in eg.read_edges(spark, os.path.join(d, "e.csv")).collect()] == [("x", "y")]
    with pytest.raises(ValueError):
        eg.read_vertices(spark, os.path.join(d, "e.csv"))
    from entitygraph.sources.files import write_vertices
    odd = spark.createDataFrame([("a", "ip", "two\nlines, \"q\" \\n", None)], "id string, t string, label string, last_seen date")
    write_vertices(odd, os.path.join(d, "out"))
    back = eg.read_vertices(spark, os.path.join(d, "out"), escaped=True).collect()
    assert [tuple(r) for r in back] == [("a", "ip", "two\nlines, \"q\" \\n", None)]


def test_each_dangling_edge_once(spark):
    from entitygraph.operators.clean import dangling_edges
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("x", "y"), ("a", "y"), ("x", "b"), ("a", "b")], "src string, dst string")
    assert sorted(map(tuple, dangling_edges(v, e).collect())) == [("a", "y"), ("x", "b"), ("x", "y")]
