"""Components of seeds against a plain walk, and the parts of a snapshot that are read."""

import random

import pytest
from fixtures import graph

import entitygraph as eg


def _members(nodes, edges, seeds):
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    found = set()
    for s in {x for x in seeds if x in near}:
        seen, todo = {s}, [s]
        while todo:
            for v in near[todo.pop()] - seen:
                seen.add(v)
                todo.append(v)
        found |= {(min(seen), v) for v in seen}
    return sorted(found)


def _walked(spark, nodes, edges, seeds, **options):
    g = eg.build_graph(*graph(spark, nodes, edges), materialize=True)
    rows = eg.seed_components(g, spark.createDataFrame([(s,) for s in seeds], "seed string"), **options).collect()
    return sorted((r["component"], r["id"]) for r in rows)


@pytest.mark.parametrize("options", [{}, {"hub_degree": 2, "max_hubs": 50}, {"max_layers": 1}])
def test_random_graphs(spark, options):
    rng = random.Random(len(options) + 5)
    nodes = [f"v{i:03d}" for i in range(120)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(75)]
    edges += [("v000", n) for n in nodes[90:110]] + [("v005", "v005")]
    seeds = [*rng.sample(nodes, 14), "v000", "v095", "v095", "no such id", None]
    assert _walked(spark, nodes, edges, seeds, **options) == _members(nodes, edges, seeds)


def test_few_seeds(spark):
    nodes, edges = ["a", "b", "c", "d", "z"], [("c", "b"), ("b", "a"), ("d", "d")]
    assert _walked(spark, nodes, edges, []) == []
    assert _walked(spark, nodes, edges, ["missing", None]) == []
    assert _walked(spark, nodes, edges, ["z", "d"]) == [("d", "d"), ("z", "z")]
    assert _walked(spark, nodes, edges, ["c"]) == [("a", "a"), ("a", "b"), ("a", "c")]


def test_walks_of_one_component_meet(spark):
    """Three seeds of one path are one component; a graph deeper than the limit
    is labelled as a whole, to the same result."""
    nodes = [f"n{i:02d}" for i in range(30)]
    edges, seeds = list(zip(nodes, nodes[1:])), ["n29", "n04", "n15"]
    g = eg.build_graph(*graph(spark, nodes + ["z"], edges), materialize=True)
    start = spark.createDataFrame([(s,) for s in seeds], "seed string")
    near = eg.resident_adjacency(g.edges)
    for most, labelled in ((64, False), (3, True)):
        stats = {}
        out = eg.seed_components(g, start, max_layers=most, adjacency=near, stats=stats)
        assert sorted((r["component"], r["id"]) for r in out.collect()) == [("n00", n) for n in nodes]
        assert stats["labelled"] is labelled


def _rows_read(df):
    """Rows that the scans of ``df`` gave, by its finished plan."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        elif node.nodeName().startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        else:
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_snapshot_is_read_in_part(spark, tmp_path):
    path = str(tmp_path / "snap")
    nodes = spark.range(40_000).selectExpr(
        "concat('ID', id) AS id", "concat('Label ', id) AS label", "'ip' AS t",
        "cast(pmod(id * 7919, 40000) AS double) / 1000 AS pr_percent")
    eg.save_snapshot(nodes, spark.createDataFrame([("ID1", "ID2")], "src string, dst string"), path)
    stored, _ = eg.load_snapshot(spark, path)
    assert stored.columns == ["id", "label", "t", "pr_percent"] and stored.count() == 40_000
    high = stored.filter("pr_percent >= 39")
    assert high.count() == 1000 and _rows_read(high) <= 10_000
    assert _rows_read(eg.search_snapshot(spark, path, "nowhere", first=False)) == 0
    for query in (" label 77 ", "id77"):
        hit = eg.search_snapshot(spark, path, query, first=False)
        assert [r["id"] for r in hit.collect()] == ["ID77"] and _rows_read(hit) <= 20_000
    assert eg.search_snapshot(spark, path, "  ").count() == 0
