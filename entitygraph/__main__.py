"""Command-line jobs (run with ``spark-submit -m`` style launchers or
``python -m entitygraph``).

``generate``  vertex + edge files -> node metrics + valid edges, kept as the
              current snapshot (parquet) and optionally as JSON lines.
``export``    the snapshot -> filtered subgraph (mode + threshold), written
              as JSON lines.
"""

from __future__ import annotations

import argparse
import sys

from .operators.metrics import compute_graph, node_payload
from .operators.subgraph import filter_graph
from .session import build_session
from .sources.files import export_subgraph, load_snapshot, read_edges, read_vertices, save_snapshot, write_graph_json


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="entitygraph")
    sub = p.add_subparsers(dest="cmd", required=True)
    g = sub.add_parser("generate", help="compute metrics and keep the snapshot")
    g.add_argument("--vertices", required=True)
    g.add_argument("--edges", required=True)
    g.add_argument("--format", default="csv", choices=["csv", "json", "parquet"])
    g.add_argument("--snapshot", required=True)
    g.add_argument("--json-out")
    g.add_argument("--half-life-days", type=float, default=30.0)
    g.add_argument("--as-of")
    g.add_argument("--dangling", default="drop", choices=["drop", "keep", "error"])
    g.add_argument("--clamp-future", action="store_true")
    x = sub.add_parser("export", help="filtered subgraph of the snapshot")
    x.add_argument("--snapshot", required=True)
    x.add_argument("--out", required=True)
    x.add_argument("--mode", default="static")
    x.add_argument("--threshold", type=float, default=0.0)
    for s in (g, x):
        s.add_argument("--master")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = build_session(args.master)
    if args.cmd == "generate":
        nodes, edges = compute_graph(read_vertices(spark, args.vertices, args.format),
                                     read_edges(spark, args.edges, args.format),
                                     half_life_days=args.half_life_days, as_of=args.as_of,
                                     dangling=args.dangling, clamp_future=args.clamp_future)
        save_snapshot(nodes, edges, args.snapshot)
        if args.json_out:
            nodes, edges = load_snapshot(spark, args.snapshot)
            write_graph_json(node_payload(nodes), edges, args.json_out)
    else:
        nodes, edges = load_snapshot(spark, args.snapshot)
        kept, kept_edges = filter_graph(nodes, edges, args.mode, args.threshold)
        export_subgraph(node_payload(kept), kept_edges, args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
