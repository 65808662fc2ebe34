"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct ``k``-word shingles (words: runs of
characters other than space and \\t..\\r, A-Z lower-cased; a shorter text is one
shingle).  Documents with ``100 * intersection >= percent * union`` are linked
and the components of the links are the groups.

1. Every set gets a SetSketch: register i holds ``floor(1 - log_b h)`` of the
   least of its elements' exponential hashes ``h`` (base ``B`` close to 1, so
   registers of two sets agree about as often as their Jaccard similarity;
   registers are maxima, so sketches of parts merge).  Equal sets (128-bit
   digest) become one class, so groups of copies never meet each other.
2. Registers are banded (four of 16 bits make one 64-bit key); classes that
   share a key are candidates.  At 0.8 a pair shares none of 32 keys with
   probability 5e-8.
3. In each bucket every class meets the bucket's pivot (least hash): the
   similarity is estimated as the maximum of the joint likelihood of the two
   register vectors given both set sizes, pairs that may reach the threshold are
   confirmed on the full sets, and the links give components.
4. Buckets whose other members are by now in one component are done.  In the
   rest the members outside the bucket's largest component meet all members,
   block by block: estimate first, then the full sets, the likeliest partner in
   a component first and no further once the component is reached.  So the
   components are those of all candidate pairs, and the pairs of a group are
   never listed.

Defined cases: null or empty text, or one without words, is the empty set, linked
with nothing; a null key takes no part and is kept; rows that repeat a key are
one vertex, with different texts one vertex of several sets: each set is a class
of its own, star links join them, and the key is kept or dropped as a whole; an empty table gives an empty result; other columns are ignored by
:func:`near_duplicates` and kept by :func:`drop_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import Graph
from ..operators.components import connected_components
from ..plans.iterate import salted_join
from .common import cut, hash_words, in_chunks, is_text, window_hashes

REGISTERS, BANDS = 128, 32
ROWS = REGISTERS // BANDS
B, RATE_A, Q = 1.001, 20.0, (1 << 16) - 2
#: A pair is confirmed on full sets when its estimate is at most this far below
#: the threshold (four standard deviations at 0.8 with 128 registers).
SLACK = 0.142
#: A block holds about so many members, and about so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 300_000
#: Key lists up to this many rows are broadcast, longer ones shuffle.
BROADCAST_KEYS = 200_000

_MULTIPLIERS = np.random.default_rng(20_240_229).integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)


# ------------------------------------------------------------ one document

def shingles(text, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the document's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if is_text(text) else []
    if not words:
        return np.empty(0, np.uint64)
    h = hash_words(words)
    size = min(k, len(words))
    out = window_hashes(h, size) if len(words) >= k else window_hashes(h, size) ^ np.uint64(size)
    return np.unique(out)


def sketch(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(items), 1024):
        np.minimum(low, (items[i:i + 1024, None] * _MULTIPLIERS[None, :]).min(0), out=low)
    u = (low.astype(np.float64) + 1.0) / 2.0 ** 64
    h = -np.log1p(-np.minimum(u, 1 - 2.0 ** -53)) / RATE_A
    return np.clip(np.floor(1 - np.log(h) / np.log(B)), 0, Q + 1).astype("<u2")


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key per band from rows of registers (the band number is mixed in)."""
    raw = np.ascontiguousarray(registers.reshape(-1, BANDS, ROWS)).view("<u8")[:, :, 0]
    z = (raw + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(29))).view(np.int64)


def likeliest_similarity(n_u, n_v, more, less) -> np.ndarray:
    """Jaccard similarity that maximises the joint likelihood of two register
    vectors, of which ``more`` registers are larger in U and ``less`` in V, for
    sets of known sizes."""
    n_u, n_v, more, less = (np.asarray(x, float) for x in (n_u, n_v, more, less))
    u = n_u / (n_u + n_v)
    v = 1 - u
    equal = REGISTERS - more - less

    def likelihood(j):
        p = -np.log1p(-np.clip(u - v * j, 1e-12, 1) * (B - 1) / B) / np.log(B)
        q = -np.log1p(-np.clip(v - u * j, 1e-12, 1) * (B - 1) / B) / np.log(B)
        return more * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):  # the likelihood has one maximum
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = likelihood(a) < likelihood(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, REGISTERS)


# ------------------------------------------------------------------- stages

def sketches(docs: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """``key, text_hash, n_shingles, digest, registers`` per row (null digest: no words)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_chunks(frames, "text"):
            out = []
            for key_, hash_, text_ in zip(part["key"].array, part["text_hash"], part["text"]):
                s = shingles(text_, k)
                out.append((key_, hash_, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s).tobytes())
                           if len(s) else (key_, hash_, 0, None, None))
            yield pd.DataFrame(out, columns=["key", "text_hash", "n_shingles", "digest", "registers"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "key long, text_hash long, n_shingles long, digest binary, registers binary")


def several_sets(rows: DataFrame) -> DataFrame:
    """``key, hub`` of every key whose rows have different sets (the hub is the
    least digest of them)."""
    own = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("digest").alias("hub"), F.max("digest").alias("top"), F.count(F.lit(1)).alias("n"), F.count("digest").alias("m"))
    return cut(own.filter("hub <> top or m > 0 and m < n").select("key", "hub"))


def star_links(own: DataFrame, several: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: the classes of each key with several sets, linked to its hub."""
    side = salted_join(own.select("key", "digest").distinct(), several, "key", "digest").filter("digest <> hub")
    a = side.select("digest", "hub").distinct().join(classes.select("digest", F.col("rep").alias("a")), "digest")
    return cut(salted_join(cut(a.select("a", "hub")), classes.select(F.col("digest").alias("hub"), F.col("rep").alias("b")), "hub", "a")
               .select("a", "b"))


def bucket_members(classes: DataFrame) -> DataFrame:
    """``bucket, band, rep`` of every band key that at least two classes share."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            yield pd.DataFrame({"rep": part["rep"], "keys": list(band_keys(_registers(part["registers"])))})

    rows = cut(classes.select("rep", "registers").mapInPandas(run, "rep long, keys array<long>")
               .select("rep", F.posexplode("keys").alias("band", "bucket")))
    shared = cut(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"),
                                            F.min(F.struct(F.xxhash64("rep"), "rep"))["rep"].alias("pivot"))
                 .filter("n > 1"))
    return cut(rows.join(shared, "bucket"))


def full_sets(docs: DataFrame, involved: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """``rep, items`` (sorted shingle hashes) of the involved classes, read again
    from the documents; ``involved``: rep, digest, and the key and text hash of a
    row that has the set."""
    few = involved.count() <= BROADCAST_KEYS
    right = F.broadcast(involved) if few else involved
    rows = (docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
            .join(right, ["key", "text_hash"]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_chunks(frames, "text"):
            sets = [shingles(t, k) for t in part["text"]]
            own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == bytes(d) for s, d in zip(sets, part["digest"])]
            yield pd.DataFrame({"rep": part["rep"].array, "items": [s.view(np.int64) for s in sets]})[own]

    got = rows.mapInPandas(run, "rep long, items array<long>")
    # a row that repeats gives equal sets (the digest tells): one of them stays
    return cut(got.groupBy("rep").agg(F.first("items").alias("items")))


def estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b, estimate`` of the pairs that may reach the threshold."""
    side = classes.select("rep", "n_shingles", "registers")
    both = (pairs.join(side.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra")), "a")
            .join(side.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb")), "b")
            .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            if len(p):
                x, y = _registers(p["ra"]), _registers(p["rb"])
                j = likeliest_similarity(p["na"], p["nb"], (x > y).sum(1), (x < y).sum(1))
                yield p[["a", "b"]].assign(estimate=j)[j >= percent / 100 - SLACK]

    return both.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(run, "a long, b long, estimate double")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    both = (pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("items").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("i"), (F.size("x") + F.size("y")).alias("n")).filter(
        100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """``rep, component``."""
    got = connected_components(Graph(vertices.select(F.col("rep").alias("id")),
                                     links.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    return cut(got.select(F.col("id").alias("rep"), "component"))


def late_links(members: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``ca, cb``: components that a pair of members of one bucket still links.

    A bucket's pivot has met all its members, so it is left out.  Members
    outside the bucket's largest component are laid against all members in
    blocks, so no task gets a whole bucket.
    """
    size = classes.select("rep", "n_shingles")
    own = cut(members.filter("rep <> pivot").select("bucket", "band", "rep").join(labels, "rep").join(size, "rep"))
    open_ = (own.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .filter("lo <> hi").select("bucket"))
    own = cut(own.join(cut(open_), "bucket"))
    top = (own.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w"))
           .groupBy("bucket").agg(F.max(F.struct("c", "component", "w")).alias("m"), F.sum("c").alias("n"), F.sum("w").alias("w")))
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(w / F.lit(BLOCK_SHINGLES))).cast("int")
    top = top.select("bucket", F.col("m.component").alias("top"), blocks(F.col("n"), F.col("w")).alias("js"),
                     blocks(F.col("n") - F.col("m.c"), F.col("w") - F.col("m.w")).alias("is"))
    rows = own.join(cut(top), "bucket")
    here = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["bucket", "band", "rep", "component", "n_shingles"]
    x = rows.filter(F.col("component") != F.col("top")).select(
        *cols, F.lit(True).alias("outer"), here(F.col("is")).alias("i"), every(F.col("js")).alias("j"))
    y = rows.select(*cols, F.lit(False).alias("outer"), every(F.col("is")).alias("i"), here(F.col("js")).alias("j"))
    laid = cut(x.unionByName(y))
    # small buckets share a task's call, a large one has its blocks in several
    calls = max(64, (laid.agg(F.sum("n_shingles").alias("w")).first()["w"] or 0) // BLOCK_SHINGLES)
    laid = (laid.withColumn("call", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(calls)).cast("int"))
            .join(classes.select("rep", "registers"), "rep").join(sets, "rep"))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple[int, int]] = set()
        for (_, band, _, _), part in g.groupby(["bucket", "band", "i", "j"], sort=False):
            _meet(part[part["outer"]], part[~part["outer"]], band, percent, out)
        return pd.DataFrame(sorted(out), columns=["ca", "cb"], dtype="int64")

    return cut(laid.groupBy("call").applyInPandas(meet, "ca long, cb long").distinct())


def _meet(a: pd.DataFrame, b: pd.DataFrame, band: int, percent: int, out: set) -> None:
    """Add the pairs of components that a member of ``a`` and one of ``b`` link."""
    if not len(a) or not len(b):
        return
    rb, nb, cb = _registers(b["registers"]), b["n_shingles"].to_numpy(), b["component"].to_numpy()
    items = b["items"].array
    for r, na, ca, own in zip(_registers(a["registers"]), a["n_shingles"], a["component"], a["items"]):
        may = (cb != ca) & (100 * np.minimum(nb, na) >= percent * np.maximum(nb, na))
        if may.any():
            may[may] = (rb[may] == r).sum(1) >= REGISTERS // 2
        at = np.flatnonzero(may)
        if not len(at):
            continue
        # a pair counts in the first band that it shares
        at = at[(rb[at] == r).reshape(-1, BANDS, ROWS).all(2).argmax(1) == band]
        j = likeliest_similarity(np.full(len(at), na), nb[at], (r > rb[at]).sum(1), (r < rb[at]).sum(1))
        for t in at[np.argsort(-j, kind="stable")][:int((j >= percent / 100 - SLACK).sum())]:
            pair = (min(ca, cb[t]), max(ca, cb[t]))
            if pair not in out:
                shared = len(np.intersect1d(own, items[t], assume_unique=True))
                if 100 * shared >= percent * (na + nb[t] - shared):
                    out.add(pair)


def link_classes(docs: DataFrame, classes: DataFrame, text: str, key: str, k: int, percent: int,
                 stars: DataFrame | None = None) -> DataFrame:
    """``rep, component`` of every class that shares a bucket or is an end of ``stars``."""
    members = bucket_members(classes)
    vertices = bucketed = cut(members.select("rep").distinct())
    if stars is not None:
        vertices = cut(bucketed.union(stars.select("a")).union(stars.select("b")).distinct())
    pairs = members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    likely = cut(estimated(cut(pairs), classes, percent))
    sets = full_sets(docs, cut(bucketed.join(classes.select("rep", "digest", "key", "text_hash"), "rep")), text, key, k)
    links = cut(confirmed(likely, sets, percent))
    labels = components(vertices, links if stars is None else links.union(stars))
    late = late_links(members, labels, classes, sets, percent)
    if not late.limit(1).count():
        return labels
    merged = components(late.select(F.col("ca").alias("rep")).union(late.select("cb")).distinct(),
                        late.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    now = merged.select(F.col("rep").alias("component"), F.col("component").alias("new"))
    return cut(labels.join(now, "component", "left").select("rep", F.coalesce("new", "component").alias("component")))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", k: int = 5,
                    percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept`` per row."""
    rows = cut(sketches(docs, text, key, k))
    own = rows.filter(F.col("digest").isNotNull() & F.col("key").isNotNull())
    classes = cut(own.groupBy("digest").agg(F.min(F.struct("key", "text_hash", "n_shingles", "registers")).alias("m"))
                  .select("digest", F.col("m.key").alias("key"), F.col("m.key").alias("rep"), F.col("m.text_hash").alias("text_hash"),
                          F.col("m.n_shingles").alias("n_shingles"), F.col("m.registers").alias("registers")))
    several = several_sets(rows)
    if several.limit(1).count():
        # a key with several sets names none of them: each is known by its digest
        unclear = salted_join(classes, several, "key", "digest", "left")
        classes = cut(unclear.withColumn("rep", F.when(F.col("hub").isNull(), F.col("key")).otherwise(F.xxhash64("digest")))
                      .select(classes.columns))
        labels = link_classes(docs, classes, text, key, k, percent, star_links(own, several, classes))
        named = cut(classes.select("digest", "key", "rep").join(labels, "rep", "left")
                    .select("digest", "key", F.coalesce("component", "rep").alias("label")))
        least = cut(named.groupBy("label").agg(F.min("key").alias("component")))
        named = cut(salted_join(named, least, "label", "digest").select("digest", "component"))
        # a row without words goes with the other rows of its key
        found = (salted_join(rows.select("key", "n_shingles", "digest", "text_hash"), several, "key", "text_hash", "left")
                 .select("key", "n_shingles", F.coalesce("digest", "hub").alias("digest")))
    else:
        labels = link_classes(docs, classes, text, key, k, percent)
        named = cut(classes.select("digest", "rep").join(labels, "rep", "left")
                    .select("digest", F.coalesce("component", "rep").alias("component")))
        found = rows.select("key", "n_shingles", "digest")
    found = found.join(named, "digest", "left")
    out = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return found.select(F.col("key").alias(key), "n_shingles", out.alias("component_id"),
                        (F.col("key").isNull() | (F.col("key") == out)).alias("kept"))


def drop_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the least key), with exactly the columns of
    ``docs``; of rows that repeat a key the one with the least text hash stays."""
    got = cut(near_duplicates(docs, text=text, key=key, k=k, percent=percent))
    gone = got.filter(~F.col("kept")).select(key)
    ids = got.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")
    if ids.limit(1).count():
        first = out.groupBy(key).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
        out = first.filter(F.col(key).isNotNull()).select("__row.*").unionByName(out.filter(F.col(key).isNull()))
    return out.select(docs.columns)
