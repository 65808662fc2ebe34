import pytest
from pyspark.sql import functions as F

import entitygraph as eg
from fixtures import F1_EDGES, F1_NODES, F1_PERCENT, F2_EDGES, F2_RAW, graph


@pytest.mark.parametrize("opts", [
    {},
    {"hub_out_degree": 1, "max_hubs": 100},   # salted hubs
    {"checkpoint_every": 1},           # cut each round
])
def test_f2_raw_ranks_equal_graphx(spark, opts):
    v, e = graph(spark, [str(i) for i in range(1, 8)], F2_EDGES)
    g = eg.build_graph(v, e)
    rows = {r["id"]: r for r in eg.pagerank(g.vertices, g.edges, raw=True, **opts).collect()}
    for k, want in F2_RAW.items():
        assert rows[k]["raw_rank"] == pytest.approx(want, abs=1e-15)
    total = sum(F2_RAW.values())
    for k, want in F2_RAW.items():
        assert rows[k]["pagerank"] == pytest.approx(want * 7 / total, rel=1e-12)
    assert sum(r["pagerank"] for r in rows.values()) == pytest.approx(7.0, rel=1e-12)


def test_f1_percent(spark):
    v, e = graph(spark, F1_NODES, F1_EDGES)
    g = eg.build_graph(v, e)
    nm = eg.node_metrics(g, as_of="2024-01-01")
    got = {r["id"]: r["pr_percent"] for r in nm.collect()}
    assert len(got) == 34
    for pct, ids in F1_PERCENT.items():
        for i in ids:
            assert got[i] == pytest.approx(pct, abs=1e-6), i
    assert sum(got.values()) == pytest.approx(100.0, abs=34 * 5e-7)
    # no dates: temporal percent equals the static one
    assert all(r["pr_temporal_percent"] == r["pr_percent"] for r in nm.collect())


def test_pagerank_matches_dataframe_power_iteration_on_trade_sample(spark):
    """Independent check: the same formula as a pandas power iteration."""
    import pandas as pd
    rv, re_ = eg.trade_graph(spark, "/root/testdata/sf0.001")
    g = eg.build_graph(rv, re_)
    ids = [r["id"] for r in g.vertices.select("id").collect()]
    ed = g.edges.toPandas()
    outdeg = ed.groupby("src").size()
    r = pd.Series(1.0, index=ids)
    for _ in range(10):
        msg = (r[ed["src"]].values / outdeg[ed["src"]].values)
        s = pd.Series(msg, index=ed["dst"].values).groupby(level=0).sum()
        r = 0.15 + 0.85 * s.reindex(ids).fillna(0.0)
    want = r * len(ids) / r.sum()
    got = {x["id"]: x["pagerank"] for x in eg.pagerank(g.vertices, g.edges).collect()}
    assert len(got) == len(ids)
    for i in ids:
        assert got[i] == pytest.approx(want[i], rel=1e-9)


def test_percent_handles_zero_total(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "id string, x double")
    out = eg.as_percent(df, "x", "p").collect()
    assert [r["p"] for r in out] == [0.0, 0.0]


def test_empty_graph(spark):
    v = spark.createDataFrame([], "id string, t string, label string, last_seen string")
    e = spark.createDataFrame([], "src string, dst string")
    g = eg.build_graph(v, e)
    assert eg.pagerank(g.vertices, g.edges).count() == 0
    assert eg.node_metrics(g, as_of="2024-01-01").count() == 0
