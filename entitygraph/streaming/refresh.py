"""File-arrival-triggered regeneration of the graph snapshot.

The batch job recomputes the graph from the current vertex and edge files
and keeps the result as the snapshot.  Here the trigger is the arrival of
new vertex or edge files, watched with Structured Streaming file sources;
each micro-batch that brings files runs the whole job (PageRank is a global
metric) on the full directories and puts a new snapshot in place.  The stream's
own checkpoint lies beside the snapshot and records which files were seen, so a
restart, also in a new session, neither misses nor replays an arrival.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import compute_graph
from ..schema import EDGE_CSV, VERTEX_CSV
from ..sources.files import read_edges, read_vertices, save_snapshot


def start_refresh(spark: SparkSession, vertices_path: str, edges_path: str, snapshot_path: str,
                  fmt: str = "csv", checkpoint_location: str | None = None, available_now: bool = False,
                  interval: str = "1 minute", **compute_options) -> StreamingQuery:
    """Start a query that regenerates ``snapshot_path`` whenever new files
    appear under ``vertices_path`` or ``edges_path``.

    ``available_now=True`` processes what is there and stops (batch-style
    catch-up); otherwise the query polls every ``interval``.
    ``compute_options`` go to :func:`compute_graph` (``half_life_days``,
    ``as_of``, ``dangling``, ...).
    """
    location = checkpoint_location or os.path.join(snapshot_path, "refresh")

    def watch(path, schema):
        reader = spark.readStream.schema(schema).format(fmt)
        return (reader.option("header", True) if fmt == "csv" else reader).load(path).select(F.lit(1).alias("row"))

    arrivals = watch(vertices_path, VERTEX_CSV).unionByName(watch(edges_path, EDGE_CSV))

    def regenerate(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        nodes, edges = compute_graph(read_vertices(spark, vertices_path, fmt),
                                     read_edges(spark, edges_path, fmt), **compute_options)
        save_snapshot(nodes, edges, snapshot_path)

    writer = arrivals.writeStream.foreachBatch(regenerate).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
