"""Entity graphs derived from relational tables.

* :func:`trade_graph` — customers, suppliers, parts, nations and regions of a
  TPC-H-style schema; edges customer->nation, supplier->nation,
  nation->region and the distinct supplier->part pairs of ``lineitem``.
  ``last_seen``: newest order date (customers) or ship date (suppliers,
  parts); null for nations and regions.
* :func:`web_graph` — hosts, pages and the links found in their HTML:
  edges host->page and page->linked url (distinct).

Both return raw ``(vertices, edges)`` frames for :func:`build_graph`.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOST_PATTERN = r"^https?://([^/?#]+)"
LINK_PATTERN = r'href="(/[^"]*)"'


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _key(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def trade_graph(spark: SparkSession, sf_dir: str, materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw trade-graph tables; ``materialize=True`` materialises the lineitem
    pair aggregate so the vertex dates and the supplier->part edges come
    from one scan of ``lineitem``."""
    region = _table(spark, sf_dir, "region")
    nation = _table(spark, sf_dir, "nation")
    customer = _table(spark, sf_dir, "customer")
    supplier = _table(spark, sf_dir, "supplier")
    part = _table(spark, sf_dir, "part")
    orders = _table(spark, sf_dir, "orders")
    lineitem = _table(spark, sf_dir, "lineitem")

    # one aggregate over lineitem feeds supplier dates, part dates and the
    # supplier->part edges (the exchange is reused inside one plan)
    pairs = lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max("l_shipdate").alias("d"))
    if materialize:
        from ..plans.iterate import cut
        pairs = cut(pairs)
    supp_seen = pairs.groupBy("l_suppkey").agg(F.max("d").cast("date").alias("last_seen"))
    part_seen = pairs.groupBy("l_partkey").agg(F.max("d").cast("date").alias("last_seen"))
    cust_seen = orders.groupBy("o_custkey").agg(F.max("o_orderdate").cast("date").alias("last_seen"))

    def v(df, prefix, key, t, label, seen=None):
        last = F.col("last_seen") if seen is not None else F.lit(None).cast("date")
        return df.select(_key(prefix, key).alias("id"), F.lit(t).alias("t"),
                         F.col(label).alias("label"), last.alias("last_seen"))

    vertices = (v(customer.join(cust_seen, customer.c_custkey == cust_seen.o_custkey, "left"),
                  "c", "c_custkey", "customer", "c_name", True)
                .unionByName(v(supplier.join(supp_seen, supplier.s_suppkey == supp_seen.l_suppkey, "left"),
                               "s", "s_suppkey", "supplier", "s_name", True))
                .unionByName(v(part.join(part_seen, part.p_partkey == part_seen.l_partkey, "left"),
                               "p", "p_partkey", "part", "p_name", True))
                .unionByName(v(nation, "n", "n_nationkey", "nation", "n_name"))
                .unionByName(v(region, "r", "r_regionkey", "region", "r_name")))

    edges = (customer.select(_key("c", "c_custkey").alias("src"), _key("n", "c_nationkey").alias("dst"))
             .unionByName(supplier.select(_key("s", "s_suppkey").alias("src"), _key("n", "s_nationkey").alias("dst")))
             .unionByName(nation.select(_key("n", "n_nationkey").alias("src"), _key("r", "n_regionkey").alias("dst")))
             .unionByName(pairs.select(_key("s", "l_suppkey").alias("src"), _key("p", "l_partkey").alias("dst"))))
    return vertices, edges


def trade_order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> order edges (``'o' || o_orderkey``): orders are not
    vertices of the trade graph, so these edges dangle."""
    orders = _table(spark, sf_dir, "orders")
    return orders.select(_key("c", "o_custkey").alias("src"), _key("o", "o_orderkey").alias("dst"))


def web_graph(spark: SparkSession, sf_dir: str, materialize: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw web-graph tables; ``materialize=True`` materialises the extracted
    links so the link pattern runs over the HTML once (it feeds both the url
    vertices and the page->url edges)."""
    pages = _table(spark, sf_dir, "pages").select(
        "page_id", "url", F.regexp_extract("url", HOST_PATTERN, 1).alias("host"), "html")
    page_v = F.concat(F.lit("p:"), F.col("page_id").cast("string"))
    links = pages.select(page_v.alias("page"), "host",
                         F.explode(F.regexp_extract_all("html", F.lit(LINK_PATTERN), 1)).alias("link"))
    if materialize:
        from ..plans.iterate import cut
        links = cut(links)
    url = F.concat(F.col("host"), F.col("link"))

    hosts = pages.select(F.concat(F.lit("h:"), "host").alias("id"), F.lit("host").alias("t"),
                         F.col("host").alias("label")).distinct()
    page_rows = pages.select(page_v.alias("id"), F.lit("page").alias("t"), F.col("url").alias("label"))
    urls = links.select(F.concat(F.lit("u:"), url).alias("id"), F.lit("url").alias("t"),
                        url.alias("label")).distinct()
    vertices = (hosts.unionByName(page_rows).unionByName(urls)
                .withColumn("last_seen", F.lit(None).cast("date")))
    edges = (pages.select(F.concat(F.lit("h:"), "host").alias("src"), page_v.alias("dst"))
             .unionByName(links.select(F.col("page").alias("src"), F.concat(F.lit("u:"), url).alias("dst")))
             .distinct())
    return vertices, edges
