"""File sources and sinks.  Everything is read with an explicit schema and
written by the executors (no collect)."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..schema import EDGE_CSV, GRAPH_DOC, VERTEX_CSV
from ..plans.iterate import cut, release, sized_partitions, table_size
from ..session import remove_path

#: Lower-cased search columns of a snapshot's node files.
ID_KEY, LABEL_KEY = "id_key", "label_key"
#: Row groups of a snapshot's node files: small, so that statistics skip much.
ROW_GROUP_BYTES = 16 << 20


def _csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV columns by header name, all text.  Files of one directory whose
    headers differ make the read fail rather than mix up columns."""
    raw = (spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
           .option("mode", "PERMISSIVE").csv(path))
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header {raw.columns}")
    return raw


def _line_breaks(c: str, kept: bool):
    """Line breaks as text, so that a written file still splits by lines."""
    if not kept:
        marked = F.replace(F.col(c), F.lit("\\"), F.lit("\\\\"))
        return F.replace(F.replace(marked, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")).alias(c)
    marked = F.replace(F.col(c), F.lit("\\\\"), F.lit("\u0000"))
    marked = F.replace(F.replace(marked, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))
    return F.replace(marked, F.lit("\u0000"), F.lit("\\")).alias(c)


def read_vertices(spark: SparkSession, path: str, fmt: str = "csv", escaped: bool = False) -> DataFrame:
    """Vertex table ``id, type, label, last_seen`` as ``id, t, label,
    last_seen``, all text; empty CSV cells read as null.

    CSV columns are found by header name, in any order; ``type`` may be called
    ``t``, all but ``id`` may be missing (null) and others are ignored.
    ``escaped``: the files were written by :func:`write_vertices`, which keeps
    line breaks as ``\\n`` and ``\\r``.
    """
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "csv":
        raw = _csv(spark, path, ["id"])
    else:
        raw = spark.read.schema(VERTEX_CSV).format(fmt).load(path)
    text = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    t = text("t") if "t" in raw.columns else text("type")
    out = raw.select(text("id").alias("id"), t.alias("t"), text("label").alias("label"), text("last_seen").alias("last_seen"))
    return out.select(*[_line_breaks(c, True) for c in ("id", "t", "label")], "last_seen") if escaped else out


def read_edges(spark: SparkSession, path: str, fmt: str = "csv", escaped: bool = False) -> DataFrame:
    """Edge table ``src, dst`` (CSV: by header name)."""
    if fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "csv":
        raw = _csv(spark, path, ["src", "dst"])
    else:
        raw = spark.read.schema(EDGE_CSV).format(fmt).load(path)
    out = raw.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    return out.select(_line_breaks("src", True), _line_breaks("dst", True)) if escaped else out


def write_vertices(vertices: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write ``id, type, label, last_seen`` with a header (CSV, line breaks
    escaped: read it with ``escaped=True``) or as given."""
    out = vertices.select("id", F.col("t").alias("type"), "label", F.col("last_seen").cast("string").alias("last_seen"))
    if fmt == "csv":
        out.select(*[_line_breaks(c, False) for c in ("id", "type", "label")], "last_seen").write.mode(mode).option(
            "header", True).option("escape", '"').csv(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def write_edges(edges: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    out = edges.select("src", "dst")
    if fmt == "csv":
        out.select(_line_breaks("src", False), _line_breaks("dst", False)).write.mode(mode).option(
            "header", True).option("escape", '"').csv(path)
    else:
        out.write.mode(mode).format(fmt).save(path)


def read_graph_json(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Graph document(s) ``{nodes: [...], links|edges: [...]}`` -> ``(nodes, edges)``.

    ``links`` wins over ``edges`` when present, ``source``/``target`` over
    ``src``/``dst``.  Metrics are kept as text (read them with
    ``to_number``).  A document is one JSON value per file (``multiLine``),
    hence one task per file; with ``lines`` it is one line of a file, which
    splits.  Large graphs use the JSON-lines directories of
    :func:`write_graph_json`.
    """
    doc = spark.read.schema(GRAPH_DOC).option("multiLine", not lines).json(path)
    nodes = doc.select(F.explode("nodes").alias("n")).select(
        "n.id", "n.label", F.coalesce(F.nullif("n.t", F.lit("")), "n.type").alias("t"), "n.last_seen",
        "n.pr_percent", "n.pr_temporal_percent")
    links = doc.select(F.explode(F.coalesce("links", "edges")).alias("l")).select(
        F.coalesce("l.source", "l.src").alias("src"), F.coalesce("l.target", "l.dst").alias("dst"))
    return nodes, links


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Node and edge payloads as JSON lines under ``path/nodes``, ``path/edges``."""
    nodes.write.mode(mode).json(os.path.join(path, "nodes"))
    edges.select("src", "dst").write.mode(mode).json(os.path.join(path, "edges"))


def read_graph_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The JSON-lines form written by :func:`write_graph_json` (splittable)."""
    node_schema = "id string, label string, t string, last_seen string, pagerank double, " \
                  "pr_percent double, recency_weight double, pagerank_temporal double, pr_temporal_percent double"
    nodes = spark.read.schema(node_schema).json(os.path.join(path, "nodes"))
    edges = spark.read.schema(EDGE_CSV).json(os.path.join(path, "edges"))
    return nodes, edges


def export_subgraph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Export a (filtered) subgraph with links as flat ``{source, target}``
    ids: JSON lines under ``path/nodes`` and ``path/links``, written by the
    executors whatever the size."""
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    nodes.write.mode(mode).json(os.path.join(path, "nodes"))
    links.write.mode(mode).json(os.path.join(path, "links"))


def _write_nodes(nodes: DataFrame, target: str) -> None:
    """Node files in the order of the static percent, with the lower-cased id
    and label and Bloom filters on both: a threshold reads the row groups that
    reach it, a search those that may hold its text."""
    have = set(nodes.columns)
    keys = {k: F.lower(F.col(c)) for k, c in ((ID_KEY, "id"), (LABEL_KEY, "label")) if {"id", "label"} <= have}
    order = [c for c in ("pr_percent", "id") if c in have]
    written = cut(nodes)             # counted, sampled and sorted: computed once
    n = sized_partitions(nodes.sparkSession, *table_size(written))
    out = written.repartitionByRange(n, *order).sortWithinPartitions(*order) if "pr_percent" in have else written
    w = out.withColumns(keys).write.option("parquet.block.size", ROW_GROUP_BYTES) if keys else out.write
    for k in keys:
        w = w.option(f"parquet.bloom.filter.enabled#{k}", "true").option(f"parquet.bloom.filter.adaptive.enabled#{k}", "true")
    w.parquet(target)
    release(written)


def save_snapshot(nodes: DataFrame, edges: DataFrame, path: str, keep: int = 2) -> None:
    """Keep the result as the current snapshot.

    Both tables go into a new folder under ``path/versions``; only when they
    are complete is its name appended to ``path/current``, so a failed job
    leaves the last snapshot in place and a reader never meets new nodes with
    old edges.  The newest ``keep`` versions stay, for readers still on them.
    A save that fails removes its own version folder.  Nodes with a
    ``pr_percent`` are stored in its order (see :func:`load_snapshot`).
    """
    spark = nodes.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    target = os.path.join(path, "versions", version)
    try:
        _write_nodes(nodes, os.path.join(target, "nodes"))
        edges.select("src", "dst").write.parquet(os.path.join(target, "edges"))
    except Exception:
        remove_path(spark, target)
        raise
    current = os.path.join(path, "current")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(current)
    newest = spark.read.schema("version string").parquet(current).orderBy(F.desc("version")).limit(keep + 1).collect()
    for row in newest[keep:]:
        remove_path(spark, os.path.join(path, "versions", row["version"]))


def _current_version(spark: SparkSession, path: str) -> str:
    try:
        current = spark.read.schema("version string").parquet(os.path.join(path, "current"))
    except AnalysisException as exc:
        raise FileNotFoundError(f"no graph snapshot at {path}: generate one first") from exc
    return os.path.join(path, "versions", current.agg(F.max("version")).first()[0])


def snapshot_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot's node files as stored, search columns included."""
    return spark.read.parquet(os.path.join(_current_version(spark, path), "nodes"))


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The last saved snapshot; a clear error when none exists.  A threshold on
    ``pr_percent`` skips the row groups below it."""
    target = _current_version(spark, path)
    return (spark.read.parquet(os.path.join(target, "nodes")).drop(ID_KEY, LABEL_KEY),
            spark.read.parquet(os.path.join(target, "edges")))
