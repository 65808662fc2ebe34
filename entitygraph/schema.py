"""Schemas and fixed values of the data model."""

from pyspark.sql import types as T

# Raw vertex CSV: every column is text (header names as in the input files).
VERTEX_CSV = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("last_seen", T.StringType()),
])

EDGE_CSV = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
])

# Graph document: {nodes: [...], links|edges: [{source|src, target|dst}]}
_NODE_DOC = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("t", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("last_seen", T.StringType()),
    # kept as text: the document may carry numbers, nulls or junk (to_number)
    T.StructField("pr_percent", T.StringType()),
    T.StructField("pr_temporal_percent", T.StringType()),
])
_LINK_DOC = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
])
GRAPH_DOC = T.StructType([
    T.StructField("nodes", T.ArrayType(_NODE_DOC)),
    T.StructField("links", T.ArrayType(_LINK_DOC)),
    T.StructField("edges", T.ArrayType(_LINK_DOC)),
])

METRICS = {"static": "pr_percent", "temporal": "pr_temporal_percent"}

# ---- fixed values (must equal the reference's for equal results) ----------
# Vertex type vocabulary; anything else is shown as "other".
TYPE_VOCABULARY = ["domain", "ip", "cert", "hash"]
OTHER_TYPE = "other"
PAGERANK_ITERATIONS = 10
PAGERANK_RESET = 0.15
HALF_LIFE_DAYS = 30.0
PERCENT_DECIMALS = 6
# Node size scale: sqrt scale from [0, max] to [5, 28].
SIZE_MIN, SIZE_MAX = 5.0, 28.0
# Organised layout: grid cell width floor, cell height, top margin, ring step.
LAYOUT_MIN_CELL_W, LAYOUT_CELL_H, LAYOUT_TOP, LAYOUT_RING_STEP = 260.0, 220.0, 20.0, 42.0
