"""Sources and sinks: vertex/edge tables (CSV, JSON lines, parquet), the
graph JSON document, snapshots, and graphs derived from relational tables."""

from .files import (  # noqa: F401
    export_subgraph, load_snapshot, read_edges, read_graph_json, read_graph_jsonl, read_vertices,
    save_snapshot, write_edges, write_graph_json, write_vertices,
)
from .tables import trade_graph, web_graph  # noqa: F401
