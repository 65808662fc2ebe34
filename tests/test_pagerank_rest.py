"""PageRank works on what still moves: vertices at rest leave with their edges."""

import importlib

import pytest

import entitygraph as eg
from fixtures import graph

pr = importlib.import_module("entitygraph.operators.pagerank")

#: A chain and a fan that come to rest in waves, ahead of a cycle, a loop and a parallel edge.
EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d"), ("x1", "y"), ("x2", "y"), ("x2", "y"), ("y", "z"),
         ("d", "k1"), ("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("k2", "out"), ("loop", "loop"), ("loop", "z")]


def by_hand(ids, edges, rounds):
    r = dict.fromkeys(ids, 1.0)
    out = {i: sum(s == i for s, _ in edges) for i in ids}
    for _ in range(rounds):
        s = dict.fromkeys(ids, 0.0)
        for a, b in edges:
            s[b] += r[a] / out[a]
        r = {i: 0.15 + 0.85 * s[i] for i in ids}
    return r


@pytest.mark.parametrize("opts", [{}, {"hub_out_degree": 1, "max_hubs": 100}, {"checkpoint_every": 1},
                                  {"iterations": 1}, {"iterations": 2}, {"iterations": 3}, {"iterations": 30}])
def test_ranks_with_waves_equal_the_iteration_by_hand(spark, opts):
    ids = sorted({x for e in EDGES for x in e} | {"alone"})
    g = eg.build_graph(*graph(spark, ids, EDGES))
    got = {r["id"]: r["raw_rank"] for r in eg.pagerank(g.vertices, g.edges, raw=True, **opts).collect()}
    assert got == pytest.approx(by_hand(ids, EDGES, opts.get("iterations", 10)), rel=1e-12)


def test_a_graph_without_cycles_is_walked_until_it_rests(spark, monkeypatch):
    sent = []
    plain = pr.contributions
    monkeypatch.setattr(pr, "contributions", lambda w, m: sent.append(1) or plain(w, m))
    edges = [(f"s{i}", f"p{i * j % 7}") for i in range(9) for j in range(5)] + [(f"s{i}", "n") for i in range(9)] + [("n", "r")]
    ids = sorted({x for e in edges for x in e})
    g = eg.build_graph(*graph(spark, ids, edges))
    got = {r["id"]: r["raw_rank"] for r in eg.pagerank(g.vertices, g.edges, raw=True).collect()}
    assert got == pytest.approx(by_hand(ids, edges, 10), rel=1e-12)
    assert len(sent) <= 4          # three rounds and one look at the edges still in use, not ten
