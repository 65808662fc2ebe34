import os
import tempfile

import entitygraph as eg
from entitygraph.streaming import start_refresh
from fixtures import F1_EDGES, F1_NODES


def _write(path, header, rows):
    with open(path, "w") as fh:
        fh.write(header + "\n")
        for r in rows:
            fh.write(",".join(r) + "\n")


def test_refresh_regenerates_snapshot_on_new_files(spark):
    d = tempfile.mkdtemp(prefix="eg-stream-")
    vdir, edir, snap = os.path.join(d, "v"), os.path.join(d, "e"), os.path.join(d, "snap")
    os.makedirs(vdir), os.makedirs(edir)
    _write(os.path.join(vdir, "part-0.csv"), "id,type,label,last_seen", [(i, t, l, "") for i, l, t in F1_NODES])
    _write(os.path.join(edir, "part-0.csv"), "src,dst", F1_EDGES[:30])
    ck = os.path.join(d, "ck")
    q = start_refresh(spark, vdir, edir, snap, checkpoint_location=ck, available_now=True, as_of="2024-01-01")
    q.awaitTermination(300)
    nodes, edges = eg.load_snapshot(spark, snap)
    assert nodes.count() == 34 and edges.count() == 30
    _write(os.path.join(edir, "part-1.csv"), "src,dst", F1_EDGES[30:])
    q = start_refresh(spark, vdir, edir, snap, checkpoint_location=ck, available_now=True, as_of="2024-01-01")
    q.awaitTermination(300)
    nodes, edges = eg.load_snapshot(spark, snap)
    assert edges.count() == 34
    top = nodes.orderBy(nodes.pr_percent.desc()).first()
    assert top["id"] == "a8"
