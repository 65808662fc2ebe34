"""Merkle dataset manifest with inclusion proofs by pointer jumping.

Every row is a leaf: H(fields), where H is the lowercase hex sha256 of its inputs
written one after another (digests as hex text) and a field is ``-`` if null, else
its UTF-8 byte count, ``:`` and its value.  Per source the leaves ascend by id, and
every ``FAN`` consecutive nodes become their H (a last run may be shorter, even one
node) until one remains, the subroot; the subroots, ordered by source, become the
root in the same way.

Proofs: each node holds a pointer to an ancestor and the siblings met on the way
there, one (left, right) pair of digests a level.  At first the pointer is the
parent.  A round joins the table with itself on the pointer: the ancestor's own
segment is appended and its pointer taken over, which doubles the distance, so
after about log2(depth) rounds every leaf points at the root.  As distances are
powers of two, only nodes whose height in their source is a multiple of the
distance are pointed at again; the others leave the table (those above the
subroots all stay).

Scale: positions come from a global index over a range partitioning, so a source
with most rows is spread.  A level is one aggregate on (source number, position /
3), ``FAN`` rows a group.  A node pointed at by more than ``HOT`` rows is joined
by broadcast; disjoint subtrees of that size are few (at most leaves / the
threshold, which grows with the table so that they stay below ``MAX_HUBS`` on a
level), and all other pointers are joined by a shuffle.  The driver gets counts
only.  Digests are kept as 32 bytes, so a proof of depth d takes at most 64 d bytes.

Defined cases: ids ascend with null first, rows of one id by their digest, and
repeated rows are leaves of their own (equal leaves are interchangeable, so their
proofs are dealt among them); a null source is a source, before the empty one; an
empty or null text is a field like any other; a row with a null id is not tampered
with; a single row is its own root with an empty proof (H of nothing); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import bounded_threshold, dense_index, release, salted_join, split_hub_join
from .common import cut

FAN = 3
#: A node that more rows point at is joined by broadcast; a level has at most MAX_HUBS of them.
HOT, MAX_HUBS = 2_000, 5_000
#: The tree over the subroots; the sources' trees are numbered from 0.
UPPER = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """32 bytes of the sha256 of the parts written one after another."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def told(value: Column) -> Column:
    """``-`` or the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return digest(*[told(f) for f in fields])


def text_of(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def tampered_text(text: Column, key: Column) -> Column:
    """The text without its line breaks where 2 divides the id's crc32."""
    even = F.crc32(key.cast("string").cast("binary")) % 2 == 0
    return F.when(F.coalesce(even, F.lit(False)), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def parents(level: DataFrame) -> DataFrame:
    """The next level of ``tree, pos, n, digest, leaves`` (``n``: nodes of the
    tree on the level) and ``run``, a node's children in order."""
    run = F.array_sort(F.collect_list(F.struct("pos", "digest", "leaves")))       # FAN at most
    up = level.groupBy("tree", F.floor(F.col("pos") / FAN).alias("up")).agg(
        run.alias("run"), F.sum("leaves").alias("leaves"), F.max("n").alias("n"))
    joined = F.array_join(F.transform("run", lambda x: text_of(x["digest"])), "")
    return up.select("tree", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), digest(joined).alias("digest"),
                     "leaves", "run")


def _joined(run: Column, start: Column, length: Column) -> Column:
    """The digests of a slice of a run, one after another."""
    return F.aggregate(F.slice(run, start, length), F.lit(b""), lambda acc, x: F.concat(acc, x["digest"]))


def node(tree: Column, height: Column, pos: Column) -> Column:
    return F.struct(tree.cast("long").alias("tree"), height.cast("int").alias("height"), pos.cast("long").alias("pos"))


def _pointers(up: DataFrame, height: int) -> DataFrame:
    """``node, to, path, leaves`` of the children of a level: the parent (of the
    last level of a source: its subroot as a leaf of the upper tree) and the
    pair of sibling digests on both sides."""
    at, own_tree = F.col("at"), F.col("tree") != UPPER
    pair = F.struct(_joined(F.col("run"), F.lit(1), at).alias("l"),
                    _joined(F.col("run"), at + 2, F.greatest(F.size("run") - at - 1, F.lit(0))).alias("r"))
    each = up.select("tree", F.col("pos").alias("up"), "n", F.posexplode("run").alias("at", "child"), "run")
    return each.select(node(F.col("tree"), F.lit(height), F.col("child.pos")).alias("node"),
                       F.when((F.col("n") == 1) & own_tree, node(F.lit(UPPER), F.lit(0), F.col("tree")))
                       .otherwise(node(F.col("tree"), F.lit(height + 1), F.col("up"))).alias("to"),
                       F.array(pair).alias("path"), F.col("child.leaves").alias("leaves"))


def build_trees(level: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """From ``tree, pos, n, digest, leaves`` (positions from 0 in each tree, at
    most ``most`` to a tree): the pointers of every level, the tops (``tree,
    digest, leaves``), and the written tables that they read."""
    pointers, tops, made, height = [], [], [], 0
    while True:
        tops.append(level.filter("n = 1").select("tree", "digest", "leaves"))
        if most <= 1:
            return pointers, reduce(DataFrame.unionByName, tops), made
        up = cut(parents(level.filter("n > 1")))
        made.append(up)
        pointers.append(_pointers(up, height))
        level, height, most = up.drop("run"), height + 1, -(-most // FAN)


def jump(table: DataFrame, n_leaves: int, kept) -> DataFrame:
    """Pointer jumping: ``table`` has ``node, to, path, leaves`` (``to`` null:
    at the root); ``kept(distance)`` tells which nodes may still be pointed at
    or are leaves.  Ends when every row has reached the root."""
    threshold, distance = bounded_threshold(n_leaves, HOT, MAX_HUBS), 1
    while not table.filter(F.col("to").isNotNull()).isEmpty():
        ahead = table.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("path").alias("more"), "leaves")
        going = table.filter(F.col("to").isNotNull() & kept(2 * distance)).withColumnRenamed("leaves", "own")
        gone = table.filter(F.col("to").isNull() & kept(2 * distance))
        met = split_hub_join(going, ahead, "to", "leaves", threshold, total_weight=n_leaves)
        met = met.select("node", F.col("next").alias("to"), F.concat("path", "more").alias("path"), F.col("own").alias("leaves"))
        before, table = table, cut(gone.select("node", "to", "path", "leaves").unionByName(met))
        release(before)
        distance *= 2
    return table


def manifest(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text",
             fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` per row.

    ``folded_root`` is the root recomputed from the leaf as it would be after
    tampering (see :func:`tampered_text`) and the original siblings.
    """
    spark = docs.sparkSession
    own = [F.col(f"`{f}`") for f in fields]
    changed = [tampered_text(c, F.col(key)) if f == text else c for f, c in zip(fields, own)]
    rows = cut(docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"),
                           leaf_digest(own).alias("digest"), leaf_digest(changed).alias("tampered")))
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest").asc()]
    placed = dense_index(rows, order, "rank", spread_ties=True)
    sources = cut(placed.groupBy("source").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("name")    # null told from text
    numbered = dense_index(sources, [F.col("source").asc_nulls_first()], "tree").select(name, "tree", "first", "n")
    leaves = cut(salted_join(placed.withColumn("name", name), numbered, "name", "rank").select(
        "id", "tampered", "tree", (F.col("rank") - F.col("first")).alias("pos"), "n", "digest",
        F.lit(1).cast("long").alias("leaves")))
    release(rows, placed)
    size = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_leaves, most, n_sources = map(int, size)

    pointers, tops, made = build_trees(leaves.select("tree", "pos", "n", "digest", "leaves"), most)
    subroots = cut(tops)
    upper = subroots.select(F.lit(UPPER).cast("long").alias("tree"), F.col("tree").alias("pos"),
                            F.lit(n_sources).cast("long").alias("n"), "digest", "leaves")
    above, top, made_above = build_trees(upper, n_sources)
    root = top.select(text_of(F.col("digest")).alias("root")).first()
    # the root points nowhere
    end = spark.createDataFrame([((UPPER, len(above), 0), None, [], n_leaves)] if root else [], POINTERS)
    table = cut(reduce(DataFrame.unionByName, [*pointers, *above, end]))
    release(*made, *made_above)
    reached = jump(table, n_leaves, lambda d: (F.col("node.tree") == UPPER) | (F.col("node.height") % d == 0))

    is_leaf = (F.col("node.height") == 0) & (F.col("node.tree") != UPPER)
    proofs = reached.filter(is_leaf).select(F.col("node.tree").alias("tree"), F.col("node.pos").alias("pos"), "path")
    # a source's only leaf is its subroot
    over = reached.filter((F.col("node.tree") == UPPER) & (F.col("node.height") == 0)).select(
        F.col("node.pos").alias("tree"), "path")
    alone = leaves.filter("n = 1").select("tree", "pos").join(over, "tree").select("tree", "pos", "path")
    proofs = proofs.unionByName(alone)

    sides = lambda x: F.concat(text_of(x["l"]), text_of(x["r"]))
    folded = F.aggregate("path", text_of(F.col("tampered")),
                         lambda acc, x: F.sha2(F.concat(text_of(x["l"]), acc, text_of(x["r"])), 256))
    out = leaves.select("id", "tampered", "tree", "pos", "digest").join(proofs, ["tree", "pos"])
    out = salted_join(out, subroots.select("tree", text_of(F.col("digest")).alias("subroot")), "tree", "pos")
    out = out.select(F.col("id").alias(key), text_of(F.col("digest")).alias("leaf"), "subroot", F.lit(root and root["root"]).cast("string").alias("root"),
                     F.sha2(F.array_join(F.transform("path", sides), ""), 256).alias("proof_sha256"),
                     folded.alias("folded_root"))
    return out.withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))


POINTERS = ("node struct<tree:bigint,height:int,pos:bigint>, to struct<tree:bigint,height:int,pos:bigint>, "
            "path array<struct<l:binary,r:binary>>, leaves bigint")
