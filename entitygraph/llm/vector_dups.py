"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length 1, where a cosine c is a distance sqrt(2 - 2c).  A
hash is floor((a . v + b) / w) with a Gaussian a and a uniform b; the hashes of a
table together are a bucket.  Vectors that share a bucket of some table are
compared exactly, in double precision.  The number of hashes in a table grows
with the log of the vectors, so that unlike vectors rarely share a bucket, and the
number of tables follows from it: a pair exactly at the threshold is missed
with probability ``MISS``, nearer ones less often.

Equal vectors are one class with a count.  Only buckets with several classes go
on, and vectors travel only to those.  A bucket is cut into blocks of about
``BLOCK`` classes; two blocks meet in one task, which multiplies their vectors and
returns a row per vector with links: how many it has, and the least member of its
component there.  Pairs are not emitted.  A pair that shares several tables
counts in the first of them, which both vectors' buckets tell.

Crowded buckets: the means of the (at most ``PIVOTS``) largest buckets beyond a
block are pivots, and every vector within half the threshold's angle of one goes to
the first such pivot's crowd.  Two members of a crowd are linked, as their angles to
the pivot add up to less than the threshold's; they are counted, not compared, and
blocks of one crowd do not meet.  So a crowd of near copies costs in proportion
to its size.  What stays quadratic, in bounded blocks, is a bucket of more than a
block of vectors that no pivot gathers.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link; repeated
rows are vectors of their own; a null id is never the least: its row has the least
id of its component, if any, and is kept only where there is none; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import Graph
from ..operators.components import connected_components
from ..plans.iterate import release, salted_join, sized_partitions
from .common import cut, give_back

COSINE, WIDTH, MISS, SEED = 0.95, 2.0, 0.005, 13
BLOCK, PIVOTS = 1024, 1024
#: Meetings of so many rows are compared together with others, larger ones in strips of so many.
SMALL = 32
#: An angle may be wrong by less than this.
_EPS = 1e-6


def collision(distance: float, width: float) -> float:
    """Probability that one hash of two vectors at ``distance`` agrees."""
    r = width / distance
    inside = 1 - math.erfc(r / math.sqrt(2))
    return inside - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def table_plan(n: int, cosine: float = COSINE, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """Hashes in a table and tables for ``n`` vectors."""
    near, far = collision(math.sqrt(max(2 - 2 * cosine, 1e-12)), width), collision(math.sqrt(2), width)
    k = max(1, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(miss) / math.log1p(-near ** k)))


def usable(vec: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True))
                      & F.exists(vec, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    z = (h ^ more.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ (z >> np.uint64(27))


def bucket_codes(x: np.ndarray, k: int, tables: int, width: float = WIDTH) -> np.ndarray:
    """64-bit bucket of every unit vector in every table."""
    rng = np.random.default_rng([SEED, x.shape[1]])
    hashes = np.floor((x @ rng.normal(size=(x.shape[1], k * tables)) + rng.uniform(0, width, k * tables)) / width)
    hashes = hashes.astype(np.int64).reshape(len(x), tables, k)
    code = np.full((len(x), tables), x.shape[1], np.uint64)
    for j in range(k):
        code = mixed(code, hashes[:, :, j])
    return code.view(np.int64)


def _by_length(column, kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of packed vectors of each length, and the vectors at length 1."""
    size = np.fromiter(map(len, column), np.int64, len(column))
    for s in np.unique(size):
        here = np.flatnonzero(size == s)
        yield here, unit(np.frombuffer(b"".join(column.iloc[here]), kind).reshape(len(here), -1))


# -------------------------------------------------------------------- classes

def classes_of(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """``id, digest`` of every row (null: unusable) and ``cls, digest, n, rep,
    vec`` of every distinct vector."""

    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (np.asarray(x, np.float64) + 0.0).astype(kind).tobytes() for x in v], dtype=object)

    vec = packed(F.when(usable(F.col("v")), F.col("v")))
    seen = cut(rows.select("id", vec.alias("vec")).withColumn("digest", F.unhex(F.sha2("vec", 256))))
    classes = (seen.filter(F.col("digest").isNotNull()).groupBy("digest")
               .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep"), F.min("vec").alias("vec")))
    return seen.select("id", "digest"), cut(classes.withColumn("cls", F.monotonically_increasing_id()))


def hashed(classes: DataFrame, kind: str, k: int, tables: int) -> DataFrame:
    """``cls, n, vec, codes``."""

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            codes = np.zeros((len(f), tables), np.int64)
            for here, x in _by_length(f["vec"], kind):
                codes[here] = bucket_codes(x, k, tables)
            yield pd.DataFrame({"cls": f["cls"], "n": f["n"], "vec": f["vec"], "codes": list(codes)})
        give_back()

    return classes.select("cls", "n", "vec").mapInPandas(code, "cls long, n long, vec binary, codes array<long>")


# --------------------------------------------------------------------- crowds

def pivots_of(packed: DataFrame, kind: str, block: int) -> list[np.ndarray]:
    """Unit means of the largest buckets with more than ``block`` classes,
    largest first: at most ``PIVOTS`` vectors come to the driver."""
    sizes = packed.select(F.posexplode("codes").alias("tbl", "code")).groupBy("tbl", "code").agg(F.count(F.lit(1)).alias("m"))
    heavy = sizes.filter(F.col("m") > block).orderBy(F.desc("m"), "tbl", "code").limit(PIVOTS).collect()
    if not heavy:
        return []
    at: dict[int, dict[int, int]] = {}
    for i, r in enumerate(heavy):
        at.setdefault(r["tbl"], {})[r["code"]] = i

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for f in frames:
            codes = np.stack(f["codes"].to_numpy()) if len(f) else np.empty((0, 0))
            for here, x in _by_length(f["vec"], kind):
                for t, known in at.items():
                    for c in np.intersect1d(codes[here, t], np.fromiter(known, np.int64)).tolist():
                        s = x[codes[here, t] == c].sum(0)
                        i = known[c]
                        if i not in total or len(total[i]) == len(s):   # lengths do not share a bucket
                            total[i] = total.get(i, 0) + s
        for i, s in total.items():
            yield pd.DataFrame({"i": i, "at": np.arange(len(s)), "s": s})

    rows = packed.select("vec", "codes").mapInPandas(sums, "i int, at int, s double").groupBy("i", "at").agg(F.sum("s").alias("s"))
    got = rows.toPandas().sort_values(["i", "at"])
    means = [g["s"].to_numpy() for _, g in got.groupby("i")]
    return [m / np.sqrt((m * m).sum()) for m in means if np.abs(m).max() > 0]


def crowded(packed: DataFrame, pivots: list[np.ndarray], kind: str, cosine: float) -> DataFrame:
    """Add ``crowd``: the first pivot within half the threshold's angle, or -1."""
    if not pivots:
        return packed.withColumn("crowd", F.lit(-1))
    least = math.cos(math.acos(cosine) / 2 - _EPS)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            crowd = np.full(len(f), -1, np.int32)
            for here, x in _by_length(f["vec"], kind):
                same = [i for i, p in enumerate(pivots) if len(p) == x.shape[1]]
                if same:
                    near = x @ np.stack([pivots[i] for i in same]).T >= least
                    crowd[here] = np.where(near.any(1), np.array(same)[near.argmax(1)], -1)
            yield f.assign(crowd=crowd)
        give_back()

    return cut(packed.mapInPandas(join, "cls long, n long, vec binary, codes array<long>, crowd int"))


# ------------------------------------------------------------------- meetings

def meetings(packed: DataFrame, block: int) -> DataFrame:
    """``tbl, code, i, j, own, cls``: the pairs of blocks at which a class meets
    others of its bucket, and its own block."""
    entries = packed.select("cls", "crowd", F.posexplode("codes").alias("tbl", "code"))
    sizes = entries.groupBy("tbl", "code", "crowd").agg(F.count(F.lit(1)).alias("m"))
    # only a crowd with more than a block of a bucket's classes has blocks of its own
    crowd = F.when((F.col("crowd") >= 0) & (F.col("m") > block), F.col("crowd")).otherwise(-1)
    sizes = sizes.groupBy("tbl", "code", crowd.alias("crowd")).agg(F.sum("m").alias("m"))
    blocks = F.ceil(F.col("m") / block).cast("int")
    buckets = sizes.groupBy("tbl", "code").agg(
        F.sum("m").alias("total"), F.sort_array(F.collect_list(F.struct("crowd", blocks.alias("k")))).alias("parts"))
    buckets = buckets.filter((F.col("total") > 1) & ~((F.size("parts") == 1) & (F.col("parts")[0]["crowd"] >= 0)))
    first = F.transform("parts", lambda p, i: F.struct(
        p["crowd"].alias("crowd"), p["k"].alias("k"),
        F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda acc, x: acc + x["k"]).alias("first")))
    buckets = buckets.select("tbl", "code", first.alias("parts"),
                             F.aggregate("parts", F.lit(0), lambda acc, x: acc + x["k"]).alias("all"))
    placed = salted_join(entries, buckets, ["tbl", "code"], "cls")
    mine = F.filter("parts", lambda p: p["crowd"] == F.col("crowd"))
    rest = F.filter("parts", lambda p: p["crowd"] == -1)
    placed = placed.withColumn("part", F.when(F.size(mine) > 0, mine[0]).otherwise(F.get(rest, F.lit(0))))
    placed = placed.withColumn("own", F.col("part.first") + F.pmod(F.xxhash64("cls", "tbl"), F.col("part.k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda b: (F.col("part.crowd") == -1)
                      | (b < F.col("part.first")) | (b >= F.col("part.first") + F.col("part.k")))
    return placed.select("tbl", "code", "own", "cls", F.explode(others).alias("other")).select(
        "tbl", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls")


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` nodes' components under edges ``a``-``b``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def met_pairs(ends: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs that meet, in bounded pieces: meetings of few
    rows (most buckets) by size, others one by one, block against block."""
    start, size = ends[:-1], np.diff(ends)
    alone = i[start] == j[start]
    for s in np.unique(size[(size <= SMALL) & alone]).tolist():
        a, b = np.triu_indices(s, 1)
        here = start[(size == s) & alone][:, None]
        yield (here + a).ravel(), (here + b).ravel()
    for g in np.flatnonzero((size > SMALL) | ~alone).tolist():
        rows = np.arange(ends[g], ends[g + 1])
        left, right = rows[own[rows] == i[rows[0]]], rows[own[rows] == j[rows[0]]]
        for x in range(0, len(left), SMALL):
            a, b = np.meshgrid(left[x:x + SMALL], right, indexing="ij")
            keep = (a < b) if alone[g] else np.ones(a.shape, bool)
            yield a[keep], b[keep]


def linked(frame: pd.DataFrame, kind: str, cosine: float) -> pd.DataFrame:
    """``cls, links, to`` of the rows of whole meetings that have links there;
    rows are in order of (tbl, code, i, j, cls)."""
    meeting = frame[["tbl", "code", "i", "j"]].to_numpy()
    ends = np.concatenate([[0], np.flatnonzero((meeting[1:] != meeting[:-1]).any(1)) + 1, [len(frame)]])
    cls, own, crowd, n = (frame[c].to_numpy() for c in ("cls", "own", "crowd", "n"))
    codes, tbl = np.stack(frame["codes"].to_numpy()), meeting[:, 0]
    length = frame["vec"].map(len).to_numpy()
    x = np.zeros((len(frame), length.max() // np.dtype(kind).itemsize))
    for here, v in _by_length(frame["vec"], kind):
        x[here, :v.shape[1]] = v
    pairs = [(np.empty(0, np.int64),) * 2]
    for a, b in met_pairs(ends, own, meeting[:, 2], meeting[:, 3]):
        near = (length[a] == length[b]) & ((crowd[a] < 0) | (crowd[a] != crowd[b]))
        a, b = a[near], b[near]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
        a, b = a[near], b[near]
        before = np.arange(codes.shape[1]) < tbl[a][:, None]       # shared by an earlier table: counted there
        new = ~((codes[a] == codes[b]) & before).any(1)
        pairs.append((a[new], b[new]))
    a, b = (np.concatenate(p) for p in zip(*pairs))
    links = np.bincount(a, n[b], len(frame)) + np.bincount(b, n[a], len(frame))
    some = np.flatnonzero(links)
    return pd.DataFrame({"cls": cls[some], "links": links[some].astype(np.int64),
                         "to": cls[local_components(len(frame), a, b)[some]]})


def links_of(meets: DataFrame, packed: DataFrame, kind: str, cosine: float, row_bytes: int) -> DataFrame:
    """``cls, links, to`` per meeting and class with links there."""
    key = ["tbl", "code", "i", "j"]
    count = meets.count()
    parts = sized_partitions(meets.sparkSession, count, count * row_bytes)
    rows = meets.join(packed, "cls").repartition(parts, *key).sortWithinPartitions(*key, "cls")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None                                                  # of a meeting that may go on
        for f in frames:
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            if not len(f):
                continue
            last = (f[key].to_numpy() == f[key].to_numpy()[-1]).all(1)
            first = int(np.flatnonzero(last)[0])
            if first:
                yield linked(f.iloc[:first], kind, cosine)
            rest = f.iloc[first:]
        if rest is not None and len(rest):
            yield linked(rest, kind, cosine)
        give_back()

    return cut(rows.mapInPandas(compare, "cls long, links long, to long"))


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vec: str = "embedding", cosine: float = COSINE,
                    block: int = BLOCK) -> DataFrame:
    """``key, n_links, component_id, kept`` per row."""
    element = vectors.schema[vec].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = vectors.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    seen, classes = classes_of(rows, kind)
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.octet_length("vec")), F.lit(0)).alias("b")).first()
    k, tables = table_plan(int(size["n"]), cosine)
    packed = cut(hashed(classes, kind, k, tables))
    packed = crowded(packed, pivots_of(packed, kind, block), kind, cosine)
    meets = cut(meetings(packed, block))
    found = links_of(meets, packed, kind, cosine, int(size["b"]) + 8 * tables + 64)

    # a crowd's members are linked with each other: its least class is their centre
    crowds = packed.filter("crowd >= 0").groupBy("crowd").agg(F.sum("n").alias("all"), F.min("cls").alias("to"))
    few = F.broadcast(crowds)                                      # PIVOTS rows at most
    crowd_rows = packed.filter("crowd >= 0").join(few, "crowd").select("cls", (F.col("all") - F.col("n")).alias("links"), "to")
    found = cut(found.unionByName(crowd_rows))
    release(meets)
    edges = found.filter(F.col("to") != F.col("cls")).select(F.col("cls").alias("src"), F.col("to").alias("dst"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    labels = connected_components(Graph(ends, edges)).withColumnRenamed("id", "cls")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    info = cut(classes.select("cls", "digest", "n", "rep").join(links, "cls", "left").join(labels, "cls", "left")
               .select("digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
                       F.coalesce("component", "cls").alias("label"), "rep"))
    least = info.groupBy("label").agg(F.min("rep").alias("least"))
    info = salted_join(info, least, "label", "digest").select("digest", "n_links", "least")
    out = salted_join(seen, info, "digest", "id", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(component == F.col("id"), component.isNull()).alias("kept"))
