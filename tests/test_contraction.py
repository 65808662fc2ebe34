"""Work that does not grow with a graph's depth, and partitions that grow with
the rows: contracted edges, walks inside a task, bucketed tables, global index."""

import random

import pytest
from pyspark.sql import functions as F

import entitygraph as eg
from entitygraph.operators.components import connected_components, local_stars
from entitygraph.operators.layers import bfs_layers, resident_adjacency
from entitygraph.plans import iterate


def _graph(spark, pairs, alone=()):
    ids = sorted({x for p in pairs for x in p} | set(alone))
    v = spark.createDataFrame([(i,) for i in ids], "id string")
    return eg.Graph(v, spark.createDataFrame(pairs, "src string, dst string"))


def _distances(pairs, roots):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for c, r in roots:
        front, depth, seen = {r}, 0, set()
        while front:
            out.update({x: (c, r, depth) for x in front})
            seen |= front
            front, depth = {y for x in front for y in near.get(x, ())} - seen, depth + 1
    return out


def _got(df):
    return {r["id"]: (r["component"], r["root"], r["layer"]) for r in df.collect()}


@pytest.mark.parametrize("small_edges", [0, 30, 200_000])
def test_layers_match_brute_force(spark, small_edges):
    rng = random.Random(small_edges)
    pairs = [(f"{g}n{rng.randrange(k)}", f"{g}n{rng.randrange(k)}") for g, k in (("a", 60), ("b", 25), ("c", 6)) for _ in range(k)]
    pairs += [("z0", f"z{i}") for i in range(1, 40)] + [("s", "s"), pairs[0], pairs[0][::-1]]
    g = _graph(spark, pairs, alone=["lone"])
    comps = connected_components(g)
    # the greatest id of each component, and a component name of its own
    roots = comps.groupBy("component").agg(F.max("id").alias("root")).withColumn("component", F.concat(F.lit("c-"), "component"))
    want = _distances(pairs, [tuple(r) for r in roots.collect()])
    got = _got(bfs_layers(g, roots, small_edges=small_edges))
    assert got == want and got["lone"] == ("c-lone", "lone", 0) and got["s"][2] == 0
    some = roots.filter("root <> 'lone' and root not like 'z%'")
    assert _got(bfs_layers(g, some, components=comps, small_edges=small_edges)) == _distances(pairs, [tuple(r) for r in some.collect()])
    assert bfs_layers(g, roots.limit(0), components=comps, small_edges=small_edges).count() == 0


def test_a_deep_path_takes_few_jobs(spark):
    n = 2000
    order = random.Random(5).sample(range(n), n)
    pairs = [(f"v{a}", f"v{b}") for a, b in zip(order, order[1:])]
    roots = spark.createDataFrame([("p", f"v{order[0]}")], "component string, root string")
    g = _graph(spark, pairs)
    comps = iterate.cut(connected_components(g))
    sc = spark.sparkContext
    sc.setJobGroup("deep-path", "layers of a path")
    got = _got(bfs_layers(g, roots, components=comps))
    sc.setJobGroup("rest", "")
    assert got == _distances(pairs, [("p", f"v{order[0]}")]) and max(x[2] for x in got.values()) == n - 1
    assert len(sc.statusTracker().getJobIdsForGroup("deep-path")) < n / 10


def test_edges_are_contracted_before_the_first_round(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(6000)]
    g = _graph(spark, pairs)
    e = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
    stars = local_stars(e)
    per_task = [r["n"] for r in stars.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(per_task) < 300 < 6000 / 4                    # a row per vertex and task at most
    stats = {}
    labels = {r["id"]: r["component"] for r in connected_components(g, stats=stats).collect()}
    again = {r["id"]: r["component"] for r in connected_components(
        eg.Graph(g.vertices, stars.select(F.col("a").alias("src"), F.col("b").alias("dst")))).collect()}
    want = {x: min(y for y, v in _distances(pairs, [("c", x)]).items()) for x in labels}
    assert labels == again == want and stats["rounds"] <= 3
    numbers = eg.Graph(spark.range(10), spark.createDataFrame([(9, 2), (10, 9), (5, 6)], "src long, dst long"))
    assert {r["id"]: r["component"] for r in connected_components(numbers).collect()}[9] == 2


def test_adjacency_is_read_in_its_buckets(spark):
    adj, hubs = resident_adjacency(_graph(spark, [(f"a{i}", f"a{i + 1}") for i in range(50)]).edges)
    front = spark.range(50).select(F.concat(F.lit("a"), "id").alias("u"), (F.col("id") % 1).cast("int").alias("salt"))
    plan = adj.join(front.hint("shuffle_hash"), ["u", "salt"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "InMemoryTableScan" not in plan
    iterate.release(adj, hubs)


def test_index_partitions_grow_with_rows_and_bytes(spark, monkeypatch):
    few, many = (iterate.cut(spark.range(n).select(F.hash("id").alias("k"), F.repeat(F.lit("x"), 100).alias("t"))) for n in (500, 20_000))
    written = lambda df: spark.read.parquet(iterate.dense_index(df, [F.col("k")])._scratch).select(F.countDistinct("__pid")).first()[0]
    small = written(few)
    monkeypatch.setattr(iterate, "PART_ROWS", 500)
    assert written(few) == small and 30 <= written(many) <= 40
    monkeypatch.setattr(iterate, "PART_ROWS", 10**6)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        assert 40 <= written(many) <= 46
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_index_spreads_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(iterate, "PART_ROWS", 1000)
    rows = iterate.cut(spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.hash("id")).alias("k")))
    out = iterate.dense_index(rows, [F.col("k")], "i", spread_ties=True)
    sizes = [r["n"] for r in spark.read.parquet(out._scratch).groupBy("__pid").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 3 * 20_000 / len(sizes) and len(sizes) >= 18
    got = out.orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(20_000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)


def test_bucketed_table_keeps_rows_and_can_be_released(spark):
    rows = spark.range(1000).select((F.col("id") % 9).alias("k"), "id")
    t = iterate.bucketed(rows, ["k"], 4)
    more = iterate.bucketed(t.filter("id >= 10").unionByName(rows.filter("id < 10").repartition(4, "k")), ["k"], 4, cluster=False)
    plan = more.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and {r["k"]: r["count"] for r in more.groupBy("k").count().collect()} == {
        k: len(range(k, 1000, 9)) for k in range(9)}
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("buckets")]
    iterate.release(t, more)
