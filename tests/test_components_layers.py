import math
from collections import defaultdict, deque

import pytest

import entitygraph as eg
from fixtures import F1_EDGES, F1_NODES, F3_EDGES, F3_NODES, graph


def _union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    groups = defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


@pytest.fixture(scope="module")
def f1(spark):
    v, e = graph(spark, F1_NODES, F1_EDGES)
    g = eg.build_graph(v, e, materialize=True)
    return g, eg.node_metrics(g, as_of="2024-01-01")


@pytest.mark.parametrize("opts", [{}, {"hub_degree": 1, "max_hubs": 10_000}])
def test_f1_components(spark, f1, opts):
    g, _ = f1
    cc = {r["id"]: r["component"] for r in eg.connected_components(g, **opts).collect()}
    want = _union_find([n[0] for n in F1_NODES], F1_EDGES)
    assert cc == want
    counts = defaultdict(int)
    for c in cc.values():
        counts[c] += 1
    assert sorted(counts.values(), reverse=True) == [27, 6, 1]
    assert cc["h99"] == "h99"


def test_f3_long_path_few_rounds(spark):
    v, e = graph(spark, F3_NODES, F3_EDGES)
    g = eg.build_graph(v, e, materialize=True)
    stats = {}
    cc = {r["id"]: r["component"] for r in eg.connected_components(g, stats=stats).collect()}
    assert cc["n199"] == "n0" and cc["n57"] == "n0"
    assert cc["z"] == "z" and cc["s"] == "s"
    assert len(set(cc.values())) == 3
    assert stats["rounds"] <= 20          # log-diameter, not 200


def test_component_size_scores_roots(spark, f1):
    g, nm = f1
    cc = eg.connected_components(g)
    sizes = {r["id"]: r["component_size"] for r in eg.with_component_size(cc).collect()}
    assert sizes["a8"] == 27 and sizes["d_fir"] == 6 and sizes["h99"] == 1
    roots = {r["component"]: r["root"] for r in eg.component_roots(cc, nm).collect()}
    assert sorted(roots.values()) == ["a21", "a8", "h99"]
    scores = {r["component"]: r["score"] for r in eg.component_scores(cc, nm).collect()}
    assert max(scores.values()) == pytest.approx(6.471316)


def _bfs_sizes(rows):
    per = defaultdict(lambda: defaultdict(int))
    for r in rows:
        per[r["root"]][r["layer"]] += 1
    return {root: [layers[i] for i in range(max(layers) + 1)] for root, layers in per.items()}


def test_f1_bfs_layers(spark, f1):
    g, nm = f1
    rows = eg.layered_components(g, nm).collect()
    assert len(rows) == 34
    assert _bfs_sizes(rows) == {"a8": [1, 3, 6, 7, 5, 5], "a21": [1, 2, 1, 2], "h99": [1]}


def test_bfs_layers_match_python_bfs_on_path(spark):
    nodes = [f"n{i}" for i in range(30)]
    edges = list(zip(nodes, nodes[1:]))
    v, e = graph(spark, nodes, edges)
    g = eg.build_graph(v, e, materialize=True)
    nm = eg.node_metrics(g, as_of="2024-01-01")
    rows = {r["id"]: r for r in eg.layered_components(g, nm).collect()}
    assert {r["root"] for r in rows.values()} == {"n10"}      # ranks tie from n10 on; smallest id
    assert rows["n0"]["layer"] == 10 and rows["n29"]["layer"] == 19
    roots = spark.createDataFrame([("n0", "n10")], "component string, root string")
    layers = eg.bfs_layers(g, roots)
    assert {r["id"]: r["layer"] for r in layers.collect()} == {k: r["layer"] for k, r in rows.items()}
    # one scan whatever the depth
    assert layers._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_layout_formula_f1(spark, f1):
    g, nm = f1
    rows = eg.organised_layout(g, nm, width=1200).collect()
    assert len(rows) == 34
    metric = {r["id"]: r["pr_percent"] for r in nm.collect()}
    lay = {r["id"]: r for r in eg.layered_components(g, nm).collect()}
    comps = defaultdict(list)
    for i, r in lay.items():
        comps[r["component"]].append(i)
    scored = sorted(comps, key=lambda c: (-max(metric[i] for i in comps[c]), c))
    cols = max(1, math.ceil(math.sqrt(len(scored))))
    cw = max(260.0, 1200 / cols)
    want = {}
    for idx, c in enumerate(scored):
        cx, cy = (idx % cols) * cw + cw / 2, (idx // cols) * 220 + 110 + 20
        by_layer = defaultdict(list)
        for i in comps[c]:
            by_layer[lay[i]["layer"]].append(i)
        for layer, ids in by_layer.items():
            ids.sort(key=lambda i: (-metric[i], i))
            for slot, i in enumerate(ids):
                a = 2 * math.pi * slot / len(ids)
                x = cx if layer == 0 else cx + 42 * layer * math.cos(a)
                y = cy if layer == 0 else cy + 42 * layer * math.sin(a)
                want[i] = (layer, slot, round(x, 3), round(y, 3))
    for r in rows:
        layer, slot, x, y = want[r["id"]]
        assert (r["layer"], r["slot"]) == (layer, slot)
        assert r["x"] == pytest.approx(x, abs=1e-3) and r["y"] == pytest.approx(y, abs=1e-3)


def test_dense_index_is_global_order(spark):
    from pyspark.sql import functions as F
    from entitygraph.plans.iterate import dense_index
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"))
    out = dense_index(df, [F.col("g").asc(), F.col("k").desc()], "i", partitions=7).collect()
    got = sorted((r["i"], r["g"], r["k"]) for r in out)
    want = sorted(((r["g"], -r["k"]) for r in df.collect()))
    assert [x[0] for x in got] == list(range(1000))
    assert [(g, -k) for _, g, k in got] == want


def test_component_members_no_seed_pairs(spark, f1):
    g, _ = f1
    cc = eg.connected_components(g)
    seeds = spark.createDataFrame([("a8",), ("d_alder",), ("h1",), ("c9",), ("missing",)], "id string")
    of = {r["seed"]: r["component"] for r in eg.component_of(cc, seeds).collect()}
    assert set(of) == {"a8", "d_alder", "h1", "c9"} and len(set(of.values())) == 2
    members = eg.component_members(cc, seeds).collect()
    assert len(members) == 33                     # 27 + 6, each vertex once
    assert len({r["id"] for r in members}) == 33
