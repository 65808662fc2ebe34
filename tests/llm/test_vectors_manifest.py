"""Merkle manifest, vector codes and embedding near-duplicates against plain
Python on small tables, with the defined odd cases."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from entitygraph.llm import manifest, vector_codes, vector_dups
from entitygraph.llm.common import ship

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, path string, tree string, rank int"
VECS = "vec_id long, embedding array<double>, label int, row string, pos string, digest string, cls string, links string"


# ------------------------------------------------------------------- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*[told(v) for v in (r[0], r[3], r[2], r[4], text)])


def tree_up(nodes):
    """Root, and for each node its sibling pairs from below."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            a = p - p % 3
            paths[i].append(("".join(level[a:p]), "".join(level[p + 1:a + 3])))
        level, at = [h(*level[a:a + 3]) for a in range(0, len(level), 3)], [p // 3 for p in at]
    return level[0], paths


def plain_manifest(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    out, subroots, per = [], [], []
    for s in names:
        group = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        top, paths = tree_up([leaf(r, r[1]) for r in group])
        subroots.append(top)
        per.append((group, paths))
    root, over = tree_up(subroots)
    for (group, paths), sub, above in zip(per, subroots, over):
        for r, p in zip(group, paths):
            path = p + above
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for a, b in path:
                x = h(a, x, b)
            out.append((r[0], leaf(r, r[1]), sub, root, h(*[a + b for a, b in path]), x, x == root))
    return sorted(map(repr, out))


def got_manifest(df):
    return sorted(repr(tuple(r)) for r in manifest.manifest(df).collect())


@pytest.fixture(scope="module")
def odd_docs(spark):
    ship(spark)
    rows = [(i, f"line {i}\nnext\n" if i % 4 else "plain", "en", "hot", i) for i in range(40)]
    rows += [(50, None, None, None, None), (None, "a\nb", "en", None, 3), (51, "", "", "", 0), (52, "ä\n" * 5000, "de", "é", 1),
             (53, "x", "en", "z", 1), (7, "line 7 again\n", "en", "hot", 7)] + [(60, "same\n", "en", "b", 2)] * 5
    return spark.createDataFrame([(*r, "leaf", "path", "tree", 1) for r in rows], DOCS)


def test_manifest_matches_plain_python(odd_docs, monkeypatch):
    want = plain_manifest([tuple(r)[:5] for r in odd_docs.collect()])
    assert got_manifest(odd_docs) == want
    monkeypatch.setattr(manifest, "HOT", 3)            # most pointers by broadcast
    assert got_manifest(odd_docs.repartition(5)) == want


def test_manifest_of_few_rows(odd_docs):
    assert manifest.manifest(odd_docs.limit(0)).count() == 0
    one = odd_docs.filter("doc_id = 52")
    (r,) = manifest.manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == h()
    assert got_manifest(one) == plain_manifest([tuple(x)[:5] for x in one.collect()])
    for n in (2, 3, 4, 9, 10, 28):                      # around full and short runs, one source
        d = odd_docs.filter(f"source = 'hot' and doc_id < {n}")
        assert got_manifest(d) == plain_manifest([tuple(x)[:5] for x in d.collect()])


def test_manifest_finds_tampering(spark):
    got = E.queries()["op11_pointer_proofs"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got.root.nunique() == 1
    for r in got.itertuples():
        text = docs.text[r.doc_id]
        touched = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None and "\n" in text
        assert r.verified == (not touched)


# ---------------------------------------------------------------------- codes

def plain_codes(rows, rounds=6):
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    if not kept:
        return []
    size = collections.Counter(len(r[1]) for r in kept)
    dim = min(size, key=lambda d: (-size[d], d))
    kept = [r for r in kept if len(r[1]) == dim]
    limit = vector_codes.component_limit(dim)
    q = np.array([[max(-limit, min(limit, int(np.floor(4096 * float(x))))) for x in r[1]] for r in kept], object)
    start = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:16]
    code, error, text = [""] * len(kept), [0] * len(kept), []
    for j in range(8):
        p = [[int(x) for x in r] for r in q[:, j * dim // 8:(j + 1) * dim // 8]]
        book = [list(p[i]) for i in start]
        nearest = lambda: [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in p]
        for _ in range(rounds):
            at = nearest()
            for k in range(len(book)):
                own = [x for x, (_, m) in zip(p, at) if m == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
        for i, (d, k) in enumerate(nearest()):
            code[i] += f"{k:02x}"
            error[i] += d
        text += [str(c) for e in book for c in e]
    by = collections.Counter()
    for r, e in zip(kept, error):
        by[r[2]] += e
    sha = h(",".join(text))
    return sorted(repr((r[0], c, e, min(by[r[2]], 2**63 - 1), sha)) for r, c, e in zip(kept, code, error))


@pytest.fixture(scope="module")
def odd_vectors(spark):
    ship(spark)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).round(3).tolist(), int(i % 3) or None) for i in range(60)]
    rows += [(100 + i, rows[3][1], 1) for i in range(40)] + [(5, rows[5][1], 2)] * 3 + [(6, rows[7][1], 2)]
    rows += [(200, None, 1), (201, [], 1), (202, [None] * 16, 1), (203, [float("nan")] * 16, 2), (204, [float("inf")] + [0.0] * 15, 2),
             (205, [0.0] * 16, None), (206, [1.0] * 8, 1), (None, rows[9][1], 7), (207, [1e300] * 16, 9), (208, [-1e300] * 16, 9)]
    return spark.createDataFrame([(*r, "r", "p", "d", "c", "l") for r in rows], VECS)


def got_codes(df):
    return sorted(repr(tuple(r)) for r in vector_codes.compress(df).collect())


def test_codes_match_plain_python(odd_vectors, monkeypatch):
    want = plain_codes([tuple(r)[:3] for r in odd_vectors.collect()])
    assert got_codes(odd_vectors) == want
    monkeypatch.setattr(vector_codes, "BUCKET_ROWS", 20)         # many buckets and owners to an entry
    assert got_codes(odd_vectors.repartition(3)) == want


def test_codes_of_few_rows(odd_vectors, spark):
    assert vector_codes.compress(odd_vectors.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.compress(odd_vectors.filter("vec_id in (200, 203)")).count() == 0
    few = odd_vectors.filter("vec_id < 4")
    assert got_codes(few) == plain_codes([tuple(r)[:3] for r in few.collect()])
    uneven = spark.createDataFrame([(i, [float(i), 2.0, -i / 3], 1) for i in range(30)], "vec_id long, embedding array<double>, label int")
    assert got_codes(uneven) == plain_codes([tuple(r) for r in uneven.collect()])


def test_only_movers_are_shuffled(odd_vectors):
    """Owners sum their members without an exchange of the resident table."""
    rows = odd_vectors.filter("vec_id < 60").selectExpr("vec_id as row", "embedding as v")
    books = [np.arange(32).reshape(16, 2) * 100 for _ in range(8)]
    _, members = vector_codes.train(vector_codes.parts_of(rows), books, 60, rounds=3)
    plan = vector_codes.owner_sums(members)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("FlatMapGroupsInPandas"):]
    assert "Bucketed: true" in below and "Exchange" not in below


# ------------------------------------------------------------- near-duplicates

def plain_links(rows):
    ok = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    top, n = list(range(len(rows))), [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.95:
                    n[a] += 1
                    n[b] += 1
                    p, q = top[a], top[b]
                    top = [p if t == q else t for t in top]
    least = {}
    for r, t in zip(rows, top):
        if r[0] is not None:
            least[t] = min(r[0], least.get(t, r[0]))
    return sorted(repr((r[0], k, least.get(t), least.get(t) == r[0])) for r, k, t in zip(rows, n, top))


def got_links(df, **how):
    return sorted(repr(tuple(r)) for r in vector_dups.near_duplicates(df, **how).collect())


def test_links_match_brute_force(odd_vectors):
    want = plain_links([tuple(r)[:2] for r in odd_vectors.collect()])
    assert got_links(odd_vectors) == want
    assert got_links(odd_vectors.repartition(3), block=4) == want
    assert vector_dups.near_duplicates(odd_vectors.limit(0)).count() == 0
    assert vector_dups.near_duplicates(odd_vectors.filter("vec_id in (200, 205)")).filter("kept and n_links = 0").count() == 2


def test_crowds_are_counted_whole(spark):
    """A crowd of near copies, in blocks far smaller than it, beside a group whose
    pairs lie well above the threshold but not all within one crowd."""
    ship(spark)
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 32))
    x = [*(a + rng.normal(size=(150, 32)) * 0.08), *(a + rng.normal(size=(20, 32)) * 0.17), *(b * s for s in range(1, 60)),
         *rng.normal(size=(60, 32))]
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(x)), x)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {r[0]: r for r in map(eval, plain_links(rows))}
    for block in (16, 1024):
        got = {r[0]: tuple(r) for r in vector_dups.near_duplicates(d, block=block).collect()}
        assert all(got[i][1] <= want[i][1] for i in want)          # nothing below the threshold is linked
        assert sum(r[1] for r in got.values()) >= 0.999 * sum(r[1] for r in want.values())
        assert all(got[i][2:] == want[i][2:] for i in want)


def test_table_plan_keeps_the_miss_rate():
    for n in (10, 10**4, 10**9):
        k, tables = vector_dups.table_plan(n)
        near = vector_dups.collision(np.sqrt(0.1), vector_dups.WIDTH)
        assert (1 - near**k) ** tables <= vector_dups.MISS
    x = vector_dups.unit(np.random.default_rng(0).normal(size=(4000, 64)))
    y = vector_dups.unit(x + np.random.default_rng(1).normal(size=x.shape) * 0.04)
    far = np.sqrt(((x - y) ** 2).sum(1)).mean()
    same = (vector_dups.bucket_codes(x, 1, 20) == vector_dups.bucket_codes(y, 1, 20)).mean()
    assert abs(same - vector_dups.collision(far, vector_dups.WIDTH)) < 0.02
