"""Plan checks: no Python in any plan, no cartesian products, no windows, pushdown
and pruning at the scans, resident edges that do not move."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
CHEAP = ["vertices", "edges", "valid_edges", "degrees", "neighbour_details", "ego_edges", "search",
         "recency_weight", "type_normalised", "vertex_universe"]


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", CHEAP + ["pagerank_percent", "connected_components"])
def test_no_python_no_cartesian(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    for bad in ["PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct",
                "BroadcastNestedLoopJoin"]:
        assert bad not in p, (name, bad)
    assert "Window" not in p, name


def test_threshold_reaches_the_scan_of_a_snapshot(spark, tmp_path):
    import entitygraph as eg
    v = spark.createDataFrame([("a", 1.0, 2.0), ("b", 7.0, 3.0)], "id string, pr_percent double, pr_temporal_percent double")
    e = spark.createDataFrame([("a", "b"), ("b", "b")], "src string, dst string")
    eg.save_snapshot(v, e, str(tmp_path / "snap"))
    kept, edges = eg.filter_graph(*eg.load_snapshot(spark, str(tmp_path / "snap")), "static", 5.0)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(pr_percent,5.0\)", _plan(kept))
    assert [tuple(r) for r in edges.collect()] == [("b", "b")]


def test_snapshot_is_replaced_whole(spark, tmp_path):
    import entitygraph as eg
    path = str(tmp_path / "snap")
    e = spark.createDataFrame([("a", "a")], "src string, dst string")
    for n in range(4):
        eg.save_snapshot(spark.createDataFrame([(str(n),)], "id string"), e, path)
    broken = spark.range(1).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        eg.save_snapshot(broken, e, path)
    assert [r["id"] for r in eg.load_snapshot(spark, path)[0].collect()] == ["3"]


@pytest.mark.parametrize("salts", [1, 3])
def test_resident_edges_do_not_move(spark, salts):
    """A round's join exchanges the messages only, with and without hubs, and
    reads the edges in their buckets: nothing is cached, nothing sorted."""
    from entitygraph.operators.pagerank import contributions, resident_weights
    from entitygraph.plans.iterate import cut
    e = cut(spark.range(1000).select((F.col("id") % 7).cast("string").alias("src"), F.col("id").cast("string").alias("dst")))
    state = cut(e.groupBy(F.col("src").alias("id")).agg(F.lit(salts).alias("nsalt")))
    msgs = state.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.col("nsalt") - 1)).alias("salt"))
    weights = resident_weights(e, state, 8)
    plan = contributions(weights, msgs)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("ShuffledHashJoin"):]
    assert below.count("Exchange") == 1 and "Sort" not in below and "InMemoryTableScan" not in below
    edges = next(line for line in below.splitlines() if "Bucketed: true" in line)
    assert "dst" in edges


def test_scan_prunes_columns(spark):
    p = _plan(E.queries()["edges"](spark, SF))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", p)
    assert schemas, p
    for s in schemas:
        assert "l_extendedprice" not in s and "c_acctbal" not in s and "html" not in s


def test_search_pushes_no_full_sort(spark):
    p = _plan(E.queries()["search"](spark, SF))
    assert "TakeOrderedAndProject" in p


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["id", "pagerank", "pr_percent"]
    assert df.count() == 390
