import json
import os
import subprocess
import sys
import tempfile

from fixtures import F1_EDGES, F1_NODES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_generate_then_export():
    d = tempfile.mkdtemp(prefix="eg-cli-")
    with open(os.path.join(d, "vertices.csv"), "w") as fh:
        fh.write("id,type,label,last_seen\n")
        for i, label, t in F1_NODES:
            fh.write(f"{i},{t},{label},2024-03-01\n")
    with open(os.path.join(d, "edges.csv"), "w") as fh:
        fh.write("src,dst\n" + "".join(f"{a},{b}\n" for a, b in F1_EDGES))
    env = dict(os.environ, PYTHONPATH=REPO)
    base = [sys.executable, "-m", "entitygraph"]
    snap, out = os.path.join(d, "snap"), os.path.join(d, "doc")
    subprocess.run(base + ["generate", "--master", "local[2]", "--vertices", os.path.join(d, "vertices.csv"),
                           "--edges", os.path.join(d, "edges.csv"), "--snapshot", snap, "--as-of", "2024-04-01"],
                   check=True, env=env, cwd=d, timeout=600)
    subprocess.run(base + ["export", "--master", "local[2]", "--snapshot", snap, "--out", out,
                           "--mode", "temporal", "--threshold", "3"],
                   check=True, env=env, cwd=d, timeout=600)
    nodes, links = (_lines(os.path.join(out, part)) for part in ("nodes", "links"))
    ids = {n["id"] for n in nodes}
    assert "a8" in ids and all(n["pr_temporal_percent"] >= 3 for n in nodes)
    assert set(nodes[0]) <= {"id", "label", "t", "pr_percent", "pr_temporal_percent", "last_seen"}
    for link in links:
        assert link["source"] in ids and link["target"] in ids


def _lines(path):
    files = [f for f in os.listdir(path) if f.endswith(".json")]
    return [json.loads(line) for f in files for line in open(os.path.join(path, f))]
