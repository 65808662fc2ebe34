"""Skewed graphs: one vertex holds a third of all edges (as source and as
target).  The salted / hub-split paths, forced with low thresholds, agree
with plain-Python brute force."""

import random
from collections import defaultdict, deque

import pytest

import entitygraph as eg
from fixtures import graph


def _hub_graph(seed):
    rnd = random.Random(seed)
    nodes = [f"v{i:03d}" for i in range(240)] + ["hub", "lonely"]
    edges = [("hub", f"v{i:03d}") for i in range(0, 80)]            # hub -> a third
    edges += [(f"v{i:03d}", "hub") for i in range(80, 160)]          # a third -> hub
    edges += [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(200, 239)]  # a separate path
    edges += [(rnd.choice(nodes[:200]), rnd.choice(nodes[:200])) for _ in range(60)]
    edges += [("hub", "v005")] * 3                                   # parallel edges
    return nodes, edges


def _pagerank(nodes, edges):
    out = defaultdict(int)
    for a, _ in edges:
        out[a] += 1
    r = {n: 1.0 for n in nodes}
    for _ in range(10):
        s = defaultdict(float)
        for a, b in edges:
            s[b] += r[a] / out[a]
        r = {n: 0.15 + 0.85 * s[n] for n in nodes}
    tot = sum(r.values())
    return {n: x * len(nodes) / tot for n, x in r.items()}


def _components(nodes, edges):
    adj = defaultdict(set)
    for a, b in edges:
        if a != b:
            adj[a].add(b), adj[b].add(a)
    comp = {}
    for n in sorted(nodes):
        if n in comp:
            continue
        q, seen = deque([n]), {n}
        while q:
            x = q.popleft()
            for y in adj[x]:
                if y not in seen:
                    seen.add(y), q.append(y)
        for x in seen:
            comp[x] = min(seen)
    return comp, adj


@pytest.mark.parametrize("seed", [1, 2])
def test_skewed_graph_all_paths(spark, seed):
    nodes, edges = _hub_graph(seed)
    v, e = graph(spark, nodes, edges)
    g = eg.build_graph(v, e, materialize=True)

    want_pr = _pagerank(nodes, edges)
    for opts in ({}, {"hub_out_degree": 10, "max_hubs": 1000}):
        got = {r["id"]: r["pagerank"] for r in eg.pagerank(g.vertices, g.edges, **opts).collect()}
        for n in nodes:
            assert got[n] == pytest.approx(want_pr[n], rel=1e-10), (opts, n)

    want_cc, adj = _components(nodes, edges)
    for opts in ({}, {"hub_degree": 10, "max_hubs": 1000}):
        got = {r["id"]: r["component"] for r in eg.connected_components(g, **opts).collect()}
        assert got == want_cc, opts

    cc = eg.connected_components(g)
    roots = cc.groupBy("component").agg({"id": "max"}).withColumnRenamed("max(id)", "root")
    root_of = {r["component"]: r["root"] for r in roots.collect()}
    want_layer = {}
    for root in root_of.values():
        dist, q = {root: 0}, deque([root])
        while q:
            x = q.popleft()
            for y in adj[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    q.append(y)
        want_layer.update(dist)
    for opts in ({}, {"hub_degree": 10, "max_hubs": 1000}):
        got = {r["id"]: r["layer"] for r in eg.bfs_layers(g, roots, small_edges=0, **opts).collect()}
        assert got == want_layer, opts
