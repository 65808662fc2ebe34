"""Approximate nearest neighbours by NN-descent and greedy graph search.

Nearness is the inner product.  Equal vectors are one node, so a vector shared
by most rows is one node with many members.  The neighbour graph is built by
rounds of joins of neighbours of neighbours: every node sends its (8-bit) vector
to the nodes in its list and to the nodes that list it, and the senders that
meet at a node are compared with each other, pairs of two old entries excepted;
what beats a node's worst entry goes back to it.  As NN-descent samples, ``SAMPLE``
new entries of a list, drawn anew in each round, take part in it and are old
after it; the others stay new.  The rounds end when few entries are new.  Queries
then search the graph greedily: the nearest ``BEAM`` nodes of a query's pool are
expanded, their neighbours are compared with the query, and so on, until the
nearest ``BEAM`` have all been expanded and no longer change.  The pool is scored again in double precision on the original vectors.

Nodes live in parts of about ``PART_NODES`` by hash of the id.  A node's vector
goes to a part once, whatever the number of its targets there, and the messages
of a batch of nodes to one part are one row; a task gets one part's messages.  A
node that more than ``HUB`` list (or more than a share of the entries that keeps
these nodes below ``MAX_HUBS``) is a hub: it has several meetings, in several
parts, and those who list it are dealt to them anew in each round; its vector is
known to all tasks.  Of more than ``MEETING`` that list a node, so many at a time
meet, in groups dealt anew in each round, and there old entries are compared too.
No sender is left out.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do vectors of another than the most frequent
length, nor rows with a null id; rows that repeat an id with different vectors
are separate candidates; a query with fewer than ``k`` candidates gets all; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back

K_GRAPH = 64
STARTS, START_GROUP = 4, 128
#: New entries of a list that take part in a round; senders that meet at once.
SAMPLE, MEETING = 12, 512
#: A node that more list has several meetings; there are at most so many such nodes.
HUB, MAX_HUBS = 4096, 100_000
#: A task sorts so many pairs at once.
SORTED = 1_000_000
CHANGED = 0.03
BEAM = 48
PART_NODES = 1500
STATE = "p int, id long, vec binary, nbr binary, sim binary, new binary, n_new long"
#: What an entry of a list is: met before, still to be drawn, drawn for the round.
OLD, WAITING, DRAWN = 0, 1, 2
FOUND = "p int, id binary, n binary, nbr binary, sim binary"


def mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    z = ids.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(ids, 0) % np.uint64(parts)).astype(np.int32)


def _lists(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of packed arrays end to end, and each row's number."""
    size = np.fromiter(map(len, column), np.int64, len(column)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column), kind), size


def _coded(v: np.ndarray) -> list[bytes]:
    """Each vector as its own scale (float32) and 8-bit components."""
    scale = np.maximum(np.abs(v).max(1) / 127, np.finfo(np.float32).tiny).astype(np.float32)
    x = np.clip(np.round(v / scale[:, None].astype(float)), -127, 127).astype(np.int8)
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, x)]


def _vectors(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(column), np.int8).reshape(len(column), -1)
    return raw[:, 4:].astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int):
    """Each ``a``'s ``k`` nearest distinct ``b`` (an entry known before stays
    known), in order of a, nearest first."""
    o = np.lexsort((fresh, b, a))
    a, b, s, fresh = a[o], b[o], s[o], fresh[o]
    one = np.ones(len(a), bool)
    one[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, s, fresh = a[one], b[one], s[one], fresh[one]
    o = np.lexsort((b, -s, a))
    a, b, s, fresh = a[o], b[o], s[o], fresh[o]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k
    return a[keep], b[keep], s[keep], fresh[keep]


def _packed(owner_ids: np.ndarray, a, b, s, parts: int) -> pd.DataFrame:
    """Candidates as one row per part that gets any: owners, the number of
    candidates of each, and the candidates end to end (``a``: sorted index into
    the owners)."""
    who, n = np.unique(a, return_counts=True)
    p = part_of(owner_ids[who], parts)
    o = np.argsort(np.repeat(p, n), kind="stable")
    b, s = b[o].astype(np.int64), s[o].astype(np.float32)
    o = np.argsort(p, kind="stable")
    p, who, n = p[o], owner_ids[who][o].astype(np.int64), n[o].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(n)])
    rows = []
    for x in np.unique(p).tolist():
        i, j = np.searchsorted(p, [x, x + 1])
        k, m = ends[i], ends[j]
        rows.append((x, who[i:j].tobytes(), n[i:j].tobytes(), b[k:m].tobytes(), s[k:m].tobytes()))
    return pd.DataFrame(rows, columns=["p", "id", "n", "nbr", "sim"])


def _unpacked(found: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners, numbers, candidates and similarities of candidate rows."""
    return tuple(np.frombuffer(b"".join(found[c]), t)
                 for c, t in (("id", np.int64), ("n", np.int32), ("nbr", np.int64), ("sim", np.float32)))


# ------------------------------------------------------------------- vectors

def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def classes_of(rows: DataFrame, vec: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``(id, rep)`` of every usable row and ``(rep, v)`` of every distinct vector."""
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    own = cut(own.filter(F.col("id").isNotNull() & usable(F.col("v"))))
    # 0.0 and -0.0 are one value for grouping
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    own = own.filter(F.size("v") == (sizes[0]["d"] if sizes else 0)).withColumn("h", F.xxhash64(F.lit(11), "v"))
    distinct = cut(own.groupBy("h", "v").agg(F.min("id").alias("least")))
    # an id with several vectors: each vector is a node of its own
    nodes = cut(distinct.withColumn("rep", F.when(F.count("*").over(Window.partitionBy("least")) == 1, F.col("least"))
                                    .otherwise(F.xxhash64("least", "h"))))
    members = cut(own.join(nodes.select("h", F.col("v").alias("w"), "rep"), "h").filter(F.col("v") == F.col("w"))
                  .select("id", "rep"))
    return members, nodes.select("rep", "v")


def start_state(nodes: DataFrame, parts: int) -> DataFrame:
    """Every node in its part with an 8-bit vector and an empty list.  Each vector
    has a scale of its own, so a few of large norm leave the others exact."""
    top = nodes.agg(F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()["m"] or 1.0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                v = np.stack(f["v"].to_numpy()) / top
                yield pd.DataFrame({"p": part_of(f["rep"].to_numpy(), parts), "id": f["rep"], "vec": _coded(v),
                                    "nbr": b"", "sim": b"", "new": b"", "n_new": 0})

    return cut(nodes.mapInPandas(run, STATE))


# --------------------------------------------------------------------- graph

def start_lists(state: DataFrame, n: int, parts: int, k: int) -> DataFrame:
    """First candidates: the nearest within random groups, a few times over."""
    groups = max(1, n // START_GROUP)
    per = -(-k // STARTS)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = f["id"].to_numpy()
            for r in range(STARTS):
                yield pd.DataFrame({"g": (mixed(ids, 100 + r) % np.uint64(groups)).astype(np.int64) * STARTS + r,
                                    "id": ids, "vec": f["vec"]})

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in f.groupby("g"):
            x, ids = _vectors(g["vec"]), g["id"].to_numpy()
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            take = min(per if n > START_GROUP else k, len(ids) - 1)
            if take < 1:
                continue
            best = np.argsort(-s, 1, kind="stable")[:, :take]
            a = np.repeat(np.arange(len(ids)), take)
            out.append(_packed(ids, a, ids[best.ravel()], np.take_along_axis(s, best, 1).ravel(), parts))
        return pd.concat(out) if out else pd.DataFrame(columns=["p", "id", "n", "nbr", "sim"])

    dealt = state.select("id", "vec").mapInPandas(deal, "g long, id long, vec binary")
    return dealt.groupBy(F.floor(F.col("g") / (16 * STARTS)).alias("call")).applyInPandas(compare, FOUND)


def hubs_of(state: DataFrame, parts: int, k: int, most: int) -> pd.DataFrame:
    """``id, vec, worst, n`` (times listed) of the nodes that more than ``most`` list."""
    def times(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            nbr, flag = _lists(f["nbr"], np.int64)[0], _lists(f["new"], np.uint8)[0]
            to, n = np.unique(nbr[flag != WAITING], return_counts=True)
            p = part_of(to, parts)
            yield pd.DataFrame([(x, to[p == x].tobytes(), n[p == x].tobytes()) for x in np.unique(p).tolist()],
                               columns=["p", "to", "n"])

    def total(f: pd.DataFrame) -> pd.DataFrame:
        to, which = np.unique(np.frombuffer(b"".join(f["to"]), np.int64), return_inverse=True)
        n = np.bincount(which, np.frombuffer(b"".join(f["n"]), np.int64), len(to)).astype(np.int64)
        return pd.DataFrame({"hub": to, "n": n})[n > most]

    heavy = cut(state.mapInPandas(times, "p int, to binary, n binary").groupBy("p").applyInPandas(total, "hub long, n long"))
    if not heavy.limit(1).count():
        return pd.DataFrame({"id": np.empty(0, np.int64), "vec": [], "worst": np.empty(0, np.float32), "n": np.empty(0, np.int64)})
    rows = state.join(F.broadcast(heavy), state["id"] == heavy["hub"]).select(
        "id", "vec", F.substring("sim", -4, 4).alias("last"), (F.length("sim") >= 4 * k).alias("full"), "n").toPandas()
    rows["worst"] = [np.frombuffer(x, np.float32)[0] if full else -np.inf for x, full in zip(rows["last"], rows["full"])]
    return rows.sort_values("id").reset_index(drop=True)[["id", "vec", "worst", "n"]]


def _meetings(to: np.ndarray, hub_ids: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Number of meetings of each node."""
    if not len(hub_ids):
        return np.ones(len(to), np.int64)
    at = np.minimum(np.searchsorted(hub_ids, to), len(hub_ids) - 1)
    return np.where(hub_ids[at] == to, salts[at], 1)


def _place(to: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Name of a node's meeting; the first one has the node's own."""
    return np.where(salt == 0, to, mixed(to ^ mixed(salt, 300).view(np.int64), 301).view(np.int64))


def messages(state: DataFrame, parts: int, k: int, turn: int, hub: int) -> DataFrame:
    """Every node with the meetings it goes to, one row for a batch and part.
    ``flag``: 1 a new entry, 2 listed by the node of the meeting, 4 one of
    several meetings."""
    hubs = hubs_of(state, parts, k, hub)
    hub_ids, hub_vec, hub_worst = hubs["id"].to_numpy(np.int64), hubs["vec"].tolist(), hubs["worst"].to_numpy(np.float32)
    salts = -(-hubs["n"].to_numpy(np.int64) // hub)

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """To every node that is no hub: who lists it."""
        for f in frames:
            nbr, size = _lists(f["nbr"], np.int64)
            flag, _ = _lists(f["new"], np.uint8)
            by = np.repeat(f["id"].to_numpy(np.int64), size)
            ok = (flag != WAITING) & ~np.isin(nbr, hub_ids)
            nbr, flag, by = nbr[ok], flag[ok], by[ok]
            p = part_of(nbr, parts)
            o = np.argsort(p, kind="stable")
            p, nbr, flag, by = p[o], nbr[o], flag[o], by[o]
            rows = []
            for x in np.unique(p).tolist():
                i, j = np.searchsorted(p, [x, x + 1])
                rows.append((x, nbr[i:j].tobytes(), by[i:j].tobytes(), flag[i:j].tobytes()))
            yield pd.DataFrame(rows, columns=["p", "to", "by", "flag"])

    def send(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        cols = ["p", "id", "vec", "worst", "n", "to", "flag"]
        if not len(own):
            return pd.DataFrame(columns=cols)
        own = own.sort_values("id").reset_index(drop=True)
        ids = own["id"].to_numpy(np.int64)
        nbr, size = _lists(own["nbr"], np.int64)
        sim, _ = _lists(own["sim"], np.float32)
        flag, _ = _lists(own["new"], np.uint8)
        worst, full, ends = np.full(len(own), -np.inf, np.float32), size >= k, np.cumsum(size)
        worst[full] = sim[ends[full] - 1]
        row = np.repeat(np.arange(len(own)), size)
        ok = flag != WAITING
        row, to, new = row[ok], nbr[ok], (flag[ok] == DRAWN).astype(np.uint8)
        t, by, told_new = (np.frombuffer(b"".join(told[c]), d) for c, d in (("to", np.int64), ("by", np.int64), ("flag", np.uint8)))
        # those who list a node deal themselves to its meetings ...
        many = _meetings(to, hub_ids, salts)
        salt = (mixed(ids[row] ^ mixed(to, 400).view(np.int64), 500 + turn) % many.astype(np.uint64)).astype(np.int64)
        sender, place, flags = [row], [_place(to, salt)], [new + np.uint8(4) * (many > 1)]
        # ... and a node goes to every meeting of those whom it knows to list it; so do hubs
        at = np.searchsorted(hub_ids, to) if len(hub_ids) else np.zeros(len(to), np.int64)
        listed_hub = hub_ids[np.minimum(at, len(hub_ids) - 1)] == to if len(hub_ids) else np.zeros(len(to), bool)
        for who, target, is_new in ((np.searchsorted(ids, t), by, (told_new == DRAWN).astype(np.uint8)),
                                    (len(ids) + at[listed_hub], ids[row[listed_hub]], new[listed_hub])):
            n = _meetings(target, hub_ids, salts)
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sender.append(np.repeat(who, n))
            place.append(_place(np.repeat(target, n), each))
            flags.append(np.repeat(is_new + np.uint8(2) + np.uint8(4) * (n > 1), n))
        row, to, flag = np.concatenate(sender), np.concatenate(place), np.concatenate(flags).astype(np.uint8)
        part = part_of(to, parts)
        o = np.lexsort((row, part))
        row, part, to, flag = row[o], part[o], to[o], flag[o]
        ids, worst = np.concatenate([ids, hub_ids]), np.concatenate([worst, hub_worst])
        raw, rows = [*own["vec"], *hub_vec], []
        x = np.frombuffer(b"".join(raw), np.int8).reshape(len(raw), -1)
        for p in np.unique(part).tolist():  # one row for each part that gets any of these messages
            i, j = np.searchsorted(part, [p, p + 1])
            who, n = np.unique(row[i:j], return_counts=True)
            rows.append((p, ids[who].tobytes(), x[who].tobytes(), worst[who].tobytes(), n.astype(np.int32).tobytes(),
                         to[i:j].tobytes(), flag[i:j].tobytes()))
        return pd.DataFrame(rows, columns=cols)

    told = state.mapInPandas(tell, "p int, to binary, by binary, flag binary")
    return (state.groupBy("p").cogroup(told.groupBy("p"))
            .applyInPandas(send, "p int, id binary, vec binary, worst binary, n binary, to binary, flag binary"))


def meet(sent: DataFrame, parts: int, k: int, turn: int) -> DataFrame:
    """One round: senders that meet at a node are compared; candidates go back."""
    def compare(f: pd.DataFrame) -> pd.DataFrame:
        by, worst, size, to, flag = (np.frombuffer(b"".join(f[c]), t) for c, t in (
            ("id", np.int64), ("worst", np.float32), ("n", np.int32), ("to", np.int64), ("flag", np.uint8)))
        owners, first, own = np.unique(by, return_index=True, return_inverse=True)
        raw = np.frombuffer(b"".join(f["vec"]), np.int8).reshape(len(by), -1)[first]
        x, worst = _vectors([v.tobytes() for v in raw]), worst[first].copy()
        row = np.repeat(own, size)
        o = np.lexsort((row, to))
        to, row, flag = to[o], row[o], flag[o]
        # a node that lists and is listed comes once
        start = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (row[1:] != row[:-1])]))
        flag = np.bitwise_or.reduceat(flag, start)
        to, row = to[start], row[start]
        new, listed, several = (flag & 1) > 0, (flag & 2) > 0, (flag & 4) > 0
        a, b, s, held = [], [], [], 0
        starts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(to)]):
            at, fresh, here = row[i:j], new[i:j], listed[i:j]
            if j - i < 2:
                continue
            groups = [np.arange(j - i)]
            if j - i - here.sum() > MEETING:  # those who list the node, dealt anew in each round
                deal = np.flatnonzero(~here)
                deal = deal[np.argsort(mixed(owners[at[deal]] ^ to[i], 600 + turn))]
                groups = [np.concatenate([np.flatnonzero(here), c]) for c in np.array_split(deal, -(-len(deal) // MEETING))]
            if several[i] or len(groups) > 1:  # two old entries need not have met
                fresh = np.ones(j - i, bool)
            for g in groups:
                one, other = at[g[fresh[g]]], at[g[~fresh[g]]]
                if not len(one):
                    continue
                m = x[one] @ x[np.concatenate([one, other])].T
                np.fill_diagonal(m, -np.inf)
                r, c = np.nonzero(m > worst[one][:, None])
                both = np.concatenate([one, other])
                a.append(one[r])
                b.append(both[c])
                s.append(m[r, c])
                back = m[:, len(one):]
                r2, c2 = np.nonzero(back > worst[other])
                a.append(other[c2])
                b.append(one[r2])
                s.append(back[r2, c2])
                held += len(r) + len(r2)
                if held > 2 * SORTED or (held > SORTED and len(a) > 2):
                    a, b, s = trim(a, b, s, worst)
                    held = 0
        if not a:
            return pd.DataFrame(columns=["p", "id", "n", "nbr", "sim"])
        a, b, s = trim(a, b, s, worst)
        out = _packed(owners, a[0], owners[b[0]], s[0], parts)
        give_back()
        return out

    def trim(a, b, s, worst):
        """Each owner's ``k`` nearest: no other can come into its list."""
        a = np.concatenate(a)
        a, b, s, _ = _best(a, np.concatenate(b), np.concatenate(s), np.zeros(len(a), bool), k)
        n = np.bincount(a, minlength=len(worst))
        full, ends = n >= k, np.cumsum(n)
        worst[full] = np.maximum(worst[full], s[ends[full] - 1])
        return [a], [b], [s]

    return sent.groupBy("p").applyInPandas(compare, FOUND)


def merged(state: DataFrame, found: DataFrame, k: int, turn: int = 0, sample: int = SAMPLE) -> DataFrame:
    """The state with each node's ``k`` nearest of its list and its candidates;
    what took part is old, and of the rest ``sample`` are drawn for the next round."""
    def run(own: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id").reset_index(drop=True)
        ids = own["id"].to_numpy()
        b0, n0 = _lists(own["nbr"], np.int64)
        s0, _ = _lists(own["sim"], np.float32)
        f0, _ = _lists(own["new"], np.uint8)
        who, n1, b1, s1 = _unpacked(more)
        a0 = np.repeat(np.arange(len(ids)), n0)
        a1 = np.repeat(np.searchsorted(ids, who), n1)
        # 3: not known before
        a, b, s, flag = _best(np.concatenate([a0, a1]), np.concatenate([b0, b1]), np.concatenate([s0, s1]),
                              np.concatenate([np.where(f0 == WAITING, WAITING, OLD), np.full(len(a1), 3)]), k)
        flag = np.where(flag == OLD, OLD, WAITING).astype(np.uint8)
        wait = np.flatnonzero(flag == WAITING)
        o = wait[np.lexsort((mixed(ids[a[wait]] ^ mixed(b[wait], 700).view(np.int64), 800 + turn), a[wait]))]
        flag[o[np.arange(len(o)) - np.searchsorted(a[o], a[o]) < sample]] = DRAWN
        cuts = np.searchsorted(a, np.arange(len(ids) + 1))
        ranges = list(zip(cuts[:-1], cuts[1:]))
        return own.assign(nbr=[b[i:j].astype(np.int64).tobytes() for i, j in ranges],
                          sim=[s[i:j].astype(np.float32).tobytes() for i, j in ranges],
                          new=[flag[i:j].tobytes() for i, j in ranges],
                          n_new=[int((flag[i:j] != OLD).sum()) for i, j in ranges])

    return state.groupBy("p").cogroup(found.groupBy("p")).applyInPandas(run, STATE)


def build_graph(nodes: DataFrame, *, k: int = K_GRAPH, changed: float = CHANGED, part_nodes: int = PART_NODES,
                hub: int = HUB) -> tuple[DataFrame, int]:
    """The neighbour graph and its number of parts."""
    n = nodes.count()
    parts = max(1, -(-n // part_nodes))
    state = start_state(nodes, parts)
    if n < 2:
        return state, parts
    k = min(k, n - 1)
    state = cut(merged(state, start_lists(state, n, parts, k), k))
    hub = max(hub, n * k // MAX_HUBS)
    for turn in count(1):  # lists only get nearer, so few entries are new in the end
        if state.agg(F.sum("n_new")).first()[0] <= changed * n * k:
            return state, parts
        state = cut(merged(state, cut(meet(messages(state, parts, k, turn, hub), parts, k, turn)), k, turn))


# -------------------------------------------------------------------- search

POOL = "q long, vec binary, nbr binary, sim binary, done binary, moved boolean"


def greedy_search(graph: DataFrame, parts: int, queries: DataFrame, *, beam: int = BEAM) -> DataFrame:
    """``q, nbr, sim``: the pool of each query node (column ``q``), when its
    nearest ``beam`` have all been expanded."""
    pool = cut(graph.join(queries, graph["id"] == queries["q"]).select(
        "q", "vec", "nbr", "sim", F.lit(b"").alias("done")))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for q, vec, nbr, done in zip(f["q"], f["vec"], f["nbr"], f["done"]):
                to = np.setdiff1d(np.frombuffer(nbr, np.int64)[:beam], np.frombuffer(done, np.int64))
                p = part_of(to, parts)
                out += [(int(x), q, vec, to[p == x].tobytes()) for x in np.unique(p)]
            yield pd.DataFrame(out, columns=["p", "q", "vec", "to"])

    def expand(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        ids, lists = own["id"].to_numpy(), own["nbr"].to_numpy()
        out = []
        for q, vec, to in zip(asked["q"], asked["vec"], asked["to"]):
            at = np.searchsorted(ids, np.frombuffer(to, np.int64))
            out.append((q, np.unique(np.frombuffer(b"".join(lists[at]), np.int64)).tobytes()))
        return pd.DataFrame(out, columns=["q", "to"])

    def split(own: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        got = dict(iter(more.groupby("q")["to"]))
        out = []
        for q, vec, nbr in zip(own["q"], own["vec"], own["nbr"]):
            if q not in got:
                continue
            w = np.setdiff1d(np.frombuffer(b"".join(got[q]), np.int64), np.frombuffer(nbr, np.int64))
            p = part_of(w, parts)
            o = np.argsort(p, kind="stable")
            w, p = w[o], p[o]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else []
            out += [(int(p[i]), q, vec, w[i:j].tobytes()) for i, j in zip(first, [*first[1:], len(w)])]
        return pd.DataFrame(out, columns=["p", "q", "vec", "to"])

    def compare(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        ids, x = own["id"].to_numpy(), _vectors(own["vec"])
        out = []
        for q, g in asked.groupby("q"):
            w = np.unique(np.frombuffer(b"".join(g["to"]), np.int64))
            w = w[w != q]
            s = x[np.searchsorted(ids, w)] @ _vectors(g["vec"].iloc[:1])[0]
            o = np.argsort(-s, kind="stable")[:2 * beam]
            out.append((q, w[o].tobytes(), s[o].tobytes()))
        return pd.DataFrame(out, columns=["q", "nbr", "sim"])

    def gather(own: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        got = dict(iter(more.groupby("q")))
        out = []
        for q, vec, nbr, sim, done in own[["q", "vec", "nbr", "sim", "done"]].itertuples(index=False):
            b, s = np.frombuffer(nbr, np.int64), np.frombuffer(sim, np.float32)
            done = np.union1d(np.frombuffer(done, np.int64), b[:beam])
            if q in got:
                b = np.concatenate([b, np.frombuffer(b"".join(got[q]["nbr"]), np.int64)])
                s = np.concatenate([s, np.frombuffer(b"".join(got[q]["sim"]), np.float32)])
            _, b, s, _ = _best(np.zeros(len(b), np.int64), b, s, np.zeros(len(b), bool), 2 * beam)
            out.append((q, vec, b.tobytes(), s.astype(np.float32).tobytes(), done.tobytes(),
                        not np.isin(b[:beam], done).all()))
        give_back()
        return pd.DataFrame(out, columns=["q", "vec", "nbr", "sim", "done", "moved"])

    ASKED = "p int, q long, vec binary, to binary"
    call = F.pmod(F.xxhash64("q"), F.lit(parts)).alias("call")
    here = graph.select("p", "id", "vec", "nbr").groupBy("p")
    settled = []
    while True:
        met = (pool.select("q", "vec", "nbr", "done").mapInPandas(ask, ASKED).groupBy("p").cogroup(here)
               .applyInPandas(expand, "q long, to binary"))
        # each query's neighbours of neighbours meet once before they go to their parts
        asked = (pool.select("q", "vec", "nbr").groupBy(call).cogroup(met.groupBy(call)).applyInPandas(split, ASKED))
        near = asked.groupBy("p").cogroup(here).applyInPandas(compare, "q long, nbr binary, sim binary")
        pool = cut(pool.groupBy(call).cogroup(near.groupBy(call)).applyInPandas(gather, POOL))
        settled.append(pool.filter(~F.col("moved")).select("q", "nbr", "sim"))
        pool = pool.filter("moved")
        if not pool.limit(1).count():
            return reduce(DataFrame.union, settled)


def nearest(rows: DataFrame, is_query: Column, *, vec: str = "embedding", key: str = "vec_id", k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest found."""
    members, nodes = classes_of(rows, vec, key)
    nodes = cut(nodes)
    graph, parts = build_graph(nodes)
    asking = cut(members.filter(is_query))
    pool = greedy_search(graph, parts, asking.select(F.col("rep").alias("q")).distinct())

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            b, n = _lists(f["nbr"], np.int64)
            # the query's own node is a candidate too: its other members
            yield pd.DataFrame({"q": np.concatenate([np.repeat(f["q"].to_numpy(), n), f["q"].to_numpy()]),
                                "rep": np.concatenate([b, f["q"].to_numpy()])})

    near = pool.select("q", "nbr").mapInPandas(pairs, "q long, rep long")
    both = near.join(nodes, "rep").join(nodes.select(F.col("rep").alias("q"), F.col("v").alias("w")), "q")
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = both.select("q", "rep", dot.alias("score"))
    # k + 1 nearest nodes with their k + 1 least members hold the k nearest rows
    near_nodes = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    least = Window.partitionBy("rep").orderBy("id")
    few = cut(members.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1).select("rep", "id"))
    top = cut(scored.withColumn("n", F.row_number().over(near_nodes)).filter(F.col("n") <= 2 * (k + 1)).select("q", "rep", "score"))
    spread = top.join(few, "rep")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    spread = (spread.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
              .groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("found")))
    found = asking.join(cut(spread).withColumnRenamed("q", "rep"), "rep")
    mine = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    out = found.select(F.col("id").alias("query_id"), F.posexplode(mine).alias("n", "x"))
    return out.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"),
                      (-F.col("x.s")).alias("score"))
