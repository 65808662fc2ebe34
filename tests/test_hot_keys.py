"""Hot keys: 90% of the vertices in one component, half of the edges into one
vertex.  With a low threshold the rows of these keys are spread over salts; the
results equal plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import entitygraph as eg
from entitygraph.plans import iterate
from fixtures import graph
from test_hub_graphs import _components


@pytest.fixture
def low(monkeypatch):
    monkeypatch.setattr(iterate, "HOT_ROWS", 10)


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    nodes = [f"v{i:03d}" for i in range(200)]
    big = nodes[:180]
    edges = [(v, "v000") for v in big] + [(rnd.choice(big), rnd.choice(big)) for _ in range(160)]
    edges += list(zip(nodes[180:], nodes[181:]))
    v, e = graph(spark, nodes, edges)
    return nodes, edges, iterate.cut(v), iterate.cut(e)


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_edges_with_known_and_unknown_ends(spark, skewed, low):
    nodes, edges, v, e = skewed
    some = set(nodes[0:200:3])
    ids = eg.valid_vertices(v).filter(F.col("id").isin(list(some)))
    want = [(a, b) for a, b in edges if a in some and b in some]
    assert _rows(eg.valid_edges(e, ids)) == Counter(want)
    assert _rows(eg.induced_edges(e, ids)) == Counter(want)
    got = eg.dangling_edges(ids, e).select("src", "dst")
    assert _rows(got) == Counter((a, b) for a, b in edges if a not in some or b not in some)


def test_ego_and_neighbours(spark, skewed, low):
    nodes, edges, v, e = skewed
    g = eg.build_graph(v, e, materialize=True)
    seeds = ["v000", "v007", "no such"]
    _, ego = eg.ego_network(g.vertices, g.edges, seeds)
    want = Counter((s, a, b) for s in seeds for a, b in edges if s in (a, b))
    assert _rows(ego.select("seed", "src", "dst")) == want
    got = _rows(eg.neighbour_details(g.vertices, g.edges).select("id", "direction", "nbr"))
    pairs = set(edges)
    assert got == Counter([(a, "out", b) for a, b in pairs] + [(b, "in", a) for a, b in pairs])


def test_components_sizes_members_layout(spark, skewed, low):
    nodes, edges, v, e = skewed
    g = eg.build_graph(v, e, materialize=True)
    want, _ = _components(nodes, edges)
    size = Counter(want.values())
    cc = eg.connected_components(g)
    assert _rows(eg.with_component_size(cc)) == Counter((n, c, size[c]) for n, c in want.items())
    seeds = spark.createDataFrame([("v003",), ("v100",)], "id string")
    assert _rows(eg.component_members(cc, seeds)) == Counter((c, n) for n, c in want.items() if c == want["v003"])
    nm = eg.node_metrics(g, as_of="2024-01-01")
    place = defaultdict(list)
    for r in eg.organised_layout(g, nm, components=cc).collect():
        place[r["component"], r["layer"]].append(r["slot"])
    assert sum(map(len, place.values())) == len(nodes)
    assert all(sorted(s) == list(range(len(s))) for s in place.values())
    kept, kept_edges = eg.focus(g, nm, "V003")
    assert kept.count() == size[want["v003"]] and kept_edges.count() == sum(want[a] == want["v003"] for a, _ in edges)


def test_hot_key_is_dealt_by_salt(spark, skewed, low):
    nodes, edges, v, e = skewed
    ids = v.select(F.col("id").alias("dst"))
    joined = iterate.salted_join(e, ids, "dst", "src", "left_semi")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "Aggregate [dst" in plan
    assert _rows(joined.select("src", "dst")) == Counter(edges)


def test_partitions_grow_with_rows(spark):
    few = iterate.resident_partitions(spark, 10 ** 6)
    assert iterate.resident_partitions(spark, 10 ** 12) == 500_000 > few


def test_scratch_is_released(spark, skewed):
    import os
    _, _, v, e = skewed
    tables = os.path.join(eg.checkpoint_dir(spark).replace("file:", ""), "tables")
    g = eg.build_graph(v, e, materialize=True)
    nm = eg.node_metrics(g, as_of="2024-01-01")
    before = set(os.listdir(tables))
    out = eg.layered_components(g, nm)
    left = set(os.listdir(tables)) - before
    assert len(left) <= 2 and out.count() == 200      # the components and the layers


def test_no_counting_where_no_key_can_be_hot(spark, skewed, monkeypatch):
    """A written table with at most HOT_ROWS rows in all is joined plainly; one
    row more, and the hot keys are counted and spread.  The rows agree."""
    nodes, edges, v, e = skewed
    got = {}
    for limit in (len(edges), len(edges) - 1):
        monkeypatch.setattr(iterate, "HOT_ROWS", limit)
        found = [eg.valid_edges(e, v.filter("id < 'v150'")), eg.induced_edges(e, v.filter("id < 'v150'")),
                 eg.ego_network(v, e, ["v000"])[1]]
        counted = ["__salts" in f._jdf.queryExecution().analyzed().toString() for f in found]
        assert counted == [limit < len(edges)] * 3
        got[limit] = [_rows(f) for f in found]
    assert got[len(edges)] == got[len(edges) - 1]


def test_hot_keys_are_found_by_classes(spark, monkeypatch):
    """Classes of keys first: the same keys and counts, but only the keys of full classes are counted."""
    monkeypatch.setattr(iterate, "HOT_ROWS", 20)
    rows = [("hot", 1)] * 50 + [(None, 2)] * 30 + [("edge", 3)] * 20 + [(f"k{i}", i) for i in range(300)]
    big = spark.createDataFrame(rows, "k string, n int")
    for keys in (["k"], ["k", "n"]):
        for classes in (1, 7, 1 << 16):
            monkeypatch.setattr(iterate, "KEY_CLASSES", classes)
            got = {r["k"]: r["__rows"] for r in iterate._rows_of_hot_keys(big, keys).collect()}
            assert got == {"hot": 50, None: 30}
    monkeypatch.setattr(iterate, "HOT_ROWS", 1000)
    assert iterate._rows_of_hot_keys(big, ["k"]).count() == 0
