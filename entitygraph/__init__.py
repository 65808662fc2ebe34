"""entitygraph — entity-graph analytics on Spark DataFrames.

Typed vertices and directed edges in, PageRank (static and recency
weighted) as percentages out, plus the exploration operators that follow:
threshold subgraphs, neighbourhoods, node details, connected components,
BFS layers, a layout table, search/focus and export.
"""

from .functions.columns import (  # noqa: F401
    metric_column, normalise_type, percent_text, recency_weight_col, to_number,
)
from .operators.clean import (  # noqa: F401
    Graph, build_graph, dangling_edges, valid_edges, valid_vertices, vertex_universe,
)
from .operators.components import (  # noqa: F401
    component_count, component_members, component_of, component_roots, component_scores, connected_components,
    ranked_components, with_component_size,
)
from .operators.layers import (  # noqa: F401
    bfs_layers, layered_components, organised_layout, resident_adjacency, seed_components, undirected_adjacency,
)
from .operators.metrics import (  # noqa: F401
    as_percent, compute_graph, graph_counts, node_metrics, node_payload, recency, sqrt_scale, top_nodes,
)
from .operators.pagerank import out_degrees, pagerank  # noqa: F401
from .operators.search import focus, search, search_snapshot  # noqa: F401
from .operators.subgraph import (  # noqa: F401
    degrees, ego_network, filter_graph, induced_edges, neighbour_details, neighbour_index, node_details,
)
from .session import build_session, checkpoint_dir, scratch_path  # noqa: F401
from .sources.files import (  # noqa: F401
    export_subgraph, load_snapshot, read_edges, read_graph_json, read_vertices, save_snapshot,
    write_edges, write_graph_json, write_vertices,
)
from .sources.tables import trade_graph, web_graph  # noqa: F401
from .streaming.refresh import start_refresh  # noqa: F401
