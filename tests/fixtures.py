"""Hand-sized graphs (see FIXTURES.md)."""

# an own sample, 34 vertices / 34 edges: four domains with shared ends (27
# vertices), one domain apart (6) and a hash without edges.
F1_NODES = (
    [(f"d_{name}", f"{name}.test", "domain") for name in ("alder", "birch", "cedar", "elm", "fir")]
    + [(f"a{i}", f"10.20.0.{i}", "ip") for i in (*range(1, 10), 20, 21)]
    + [(f"c{i}", f"CN=tree-{i}", "cert") for i in (1, 2, 3, 4, 9)]
    + [(f"h{i}", f"sample-{i}", "hash") for i in (*range(1, 11), 20, 21, 99)]
)
F1_LINKS = {
    "d_alder": "a1 a2 a3 c1 h1 h2", "d_birch": "a3 a4 c2 h3 h4 h5", "d_cedar": "a5 a6 c2 c3 h6",
    "d_elm": "a6 a7 a8 c4 h7 h8", "h1": "a1", "h3": "a8", "h4": "a4", "h7": "a9", "h9": "a8", "h10": "a9",
    "d_fir": "a20 c9 h20", "h20": "a21", "h21": "a21",
}
F1_EDGES = [(src, dst) for src, dsts in F1_LINKS.items() for dst in dsts.split()]
# Expected static percents (10 rounds, reset 0.15), from a plain-Python power
# iteration; tests/test_graphx_oracle.py holds the graph against GraphX too.
F1_PERCENT = {
    6.471316: ["a8"],
    6.424891: ["a21"],
    6.161815: ["a9"],
    4.614306: ["a1", "a4"],
    2.865622: ["a6", "c2"],
    2.803721: ["a3", "a20", "c9", "h20"],
    2.556120: ["a5", "c3", "h6"],
    2.494220: ["a2", "a7", "c1", "c4", "h1", "h2", "h3", "h4", "h5", "h7", "h8"],
    2.184718: ["d_alder", "d_birch", "d_cedar", "d_elm", "d_fir", "h9", "h10", "h21", "h99"],
}

# PageRank corner cases.
F2_EDGES = [("1", "2"), ("1", "2"), ("2", "3"), ("3", "1"), ("4", "4"), ("5", "1"), ("2", "6"), ("6", "7")]
F2_RAW = {"1": 0.6970437663482544, "2": 0.7215692959348146, "3": 0.45666695077229613, "4": 1.0,
          "5": 0.15, "6": 0.45666695077229613, "7": 0.5695437663482543}

# long path n0 -> ... -> n199, isolated z, self-loop-only s.
F3_PATH = [f"n{i}" for i in range(200)]
F3_EDGES = [(a, b) for a, b in zip(F3_PATH, F3_PATH[1:])] + [("s", "s")]
F3_NODES = F3_PATH + ["z", "s"]

# dirty vertices and edges (as_of 2024-04-01, half-life 30).
F4_VERTICES = [
    ("a", "ip", "1.1.1.1", "2024-03-01"),
    ("b", None, "B", None),
    ("c", "hash", "B", "garbage"),
    ("d", "Domain", None, "2024-03"),
    ("e", "weird", "e.example", "2030-01-01"),
    ("a", "cert", "dup", "2024-01-01"),
    (None, "hash", "x", None),
]
F4_EDGES = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("a", "ghost"), (None, "b")]
F4_WEIGHT = {"a": 0.48857998421712295, "b": 1.0, "c": 1.0, "d": 0.48857998421712295,
             "e": 1.208186641752356e+21}


def graph(spark, nodes, edges):
    """Raw (vertices, edges) frames from bare ids or ``(id, label, type)`` tuples."""
    if nodes and isinstance(nodes[0], str):
        nodes = [(n, None, None) for n in nodes]
    rows = [(n[0], n[2], n[1], None) for n in nodes]
    v = spark.createDataFrame(rows, "id string, t string, label string, last_seen string")
    e = spark.createDataFrame(list(edges), "src string, dst string")
    return v, e
