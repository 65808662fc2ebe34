"""Best-fit packing of token sequences by bin completion.

Documents are encoded, closed with an end id and cut into pieces of at most
``capacity`` tokens.  Only the number of pieces of each length matters for the
packing, and there are at most ``capacity`` lengths, so the search runs on that
histogram on the driver whatever the number of documents, and a decision is
taken for many sequences at once ("this filling, as often as the stock lasts").

Search (:func:`plan_bins`): around the longest remaining piece the undominated
fillings are enumerated lazily, least waste first (all of them: a table of
reachable sums keeps the enumeration out of branches without a filling, and a
filling is dominated if a piece in stock fits beside it or in place of one,
two or all of its pieces without more waste).  A filling is taken as often as
the stock lasts, then less often.  A branch is cut when its waste exceeds what
the incumbent allows (incumbent - 1 sequences), when the rest's lower bound
(Martello-Toth L2) does, or when the same rest was met before; for all bounds
the capacity is the greatest sum that pieces can reach.  Incumbents are
best-fit decreasing, made better by emptying some of their
sequences (mostly wasteful ones) and completing those anew (:func:`refill`).
The search ends at the lower bound, when no branch is left, or after
``max_nodes`` nodes (fillings looked at) for each of its two orders, all after a
complete solution, which best-fit decreasing gives; refilling after
``max_looks`` of them.  The result says which: ``gap`` is the number of sequences
above the proven lower bound (0: no packing has fewer).

The plan goes back as one table: for each length, runs of piece numbers with
their sequence and offset.  Each step of the search uses up a length or brings
a length below its use in that filling, so there are at most
``sum(1 + capacity / length)`` steps (about 41,000 at 4096), and refilling adds
at most one for each filling looked at, with at most 90 lengths each: a proven bound for
what the tasks receive.  Pieces are numbered within (length, salt) groups, so a
length shared by most rows is spread.

Defined cases: null or empty text is the end id alone; repeated rows are packed
one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from math import inf
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, in_chunks
from .tokens import encoder

CAPACITY = 4096
END_ID = 1
MAX_NODES = 2000
MAX_LOOKS = 30_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, *, text: str = "text", key: str = "doc_id", tokenizer: str | None = None,
               kind: str = "word", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``key, piece, start, length, ids_crc32`` (and ``ids``: little-endian
    unsigned 32-bit) of every piece of every document."""
    path = str(tokenizer or tokenizer_path())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, kind)
        for part in in_chunks(frames, "__text"):
            flat, size = enc.encode(part["__text"])
            at, rows = 0, []
            for doc, n in zip(part["__key"].array, size.tolist()):
                ids = np.empty(n + 1, "<u4")
                ids[:n], ids[n] = flat[at:at + n], end_id
                at += n
                raw = memoryview(ids.tobytes())
                for k, start in enumerate(range(0, n + 1, capacity)):
                    piece = raw[4 * start:4 * min(start + capacity, n + 1)]
                    rows.append((doc, k, start, len(piece) // 4, zlib.crc32(piece), *([bytes(piece)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=names).astype({"piece": "int32"})

    names = ["__key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kind_of_key = docs.schema[key].dataType.simpleString()
    ddl = f"__key {kind_of_key}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    got = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInPandas(run, ddl)
    return got.withColumnRenamed("__key", key)


# ---------------------------------------------------------------- the search

def lower_bound(stock: np.ndarray, capacity: int) -> int:
    """Martello-Toth L2 for ``stock[length]`` pieces of each length."""
    n = np.arange(capacity + 1)
    count, total = np.concatenate([[0], np.cumsum(stock)]), np.concatenate([[0], np.cumsum(stock * n)])
    half = capacity // 2
    k = np.arange(1, half + 1)  # pieces shorter than k are left out
    big = count[-1] - count[capacity - k + 1]
    mid = count[capacity - k + 1] - count[half + 1]
    free = mid * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    best = big + mid + np.maximum(0, -(-(small - free) // capacity))
    return max(-(-int(total[-1]) // capacity), int(best.max(initial=0)))


def best_fit(stock: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on the histogram: ``(uses of each length, times)``."""
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    done = []
    for length in np.flatnonzero(stock)[::-1].tolist():
        left = int(stock[length])
        while left:
            fits = [r for r in open_ if r >= length]
            if fits:
                room = min(fits)
                uses, times = open_[room].pop()
            else:
                # as many new sequences as hold what is left, filled to the brim
                room, uses = capacity, {}
                times = max(1, left // (capacity // length))
            each = min(room // length, max(1, left // times))
            used = min(times, left // each)
            if used < times:
                open_.setdefault(room, []).append((uses, times - used))
            elif room in open_ and not open_[room]:
                del open_[room]
            left -= used * each
            now, rest = {**uses, length: uses.get(length, 0) + each}, room - each * length
            if rest:
                open_.setdefault(rest, []).append((now, used))
            else:
                done.append((now, used))
        open_ = {r: x for r, x in open_.items() if x}
    return done + [x for xs in open_.values() for x in xs]


class Stock:
    """What is left of each length, with the sums that the shorter lengths
    reach (``reach[i]``: sums of pieces of the ``i`` shortest lengths), so that
    an enumeration never enters a branch without a filling."""

    def __init__(self, stock: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, stock.copy()
        self.lengths = np.flatnonzero(stock)
        self.reach = np.zeros((len(self.lengths) + 1, capacity + 1), bool)
        self.reach[0, 0] = True
        self.known = 0  # rows of ``reach`` that hold for what is left now

    def take(self, uses: dict[int, int], times: int) -> None:
        """Use up (or with negative ``times`` give back) pieces."""
        for x, n in uses.items():
            most = self.capacity // x
            before = min(int(self.left[x]), most)
            self.left[x] -= n * times
            if min(int(self.left[x]), most) != before:
                self.known = min(self.known, int(np.searchsorted(self.lengths, x)))

    def know(self, rows: int) -> None:
        for i in range(self.known, rows):
            x = int(self.lengths[i])
            now, many, step = self.reach[i].copy(), min(int(self.left[x]), self.capacity // x), 1
            while many > 0:  # 1, 2, 4, ... pieces at once
                some = min(step, many)
                now[x * some:] |= now[:len(now) - x * some].copy()
                many, step = many - some, step * 2
            self.reach[i + 1] = now
        self.known = max(self.known, rows)

    def exactly(self, room: int, rows: int, taken: int, short_first: bool) -> Iterator[list[int]]:
        """Every multiset of the ``rows`` shortest lengths that sums to
        ``room``, longest piece first; ``taken`` pieces of the longest of these
        lengths are in use already."""
        if room == 0:
            yield []
            return
        rows = min(rows, int(np.searchsorted(self.lengths, room, "right")))
        have = self.left[self.lengths[:rows]]
        if taken and rows:
            have[-1] -= taken
        # a deep search suspends one of these at every step: only what is still to come is kept
        at = np.flatnonzero((have > 0) & self.reach[1:rows + 1, room]).astype(np.int32)
        at = at if short_first else at[::-1]
        have = np.minimum(have[at], room).astype(np.int32)
        for i, most in zip(map(int, at), map(int, have)):
            x = int(self.lengths[i])
            for n in range(min(most, room // x), 0, -1):
                if self.reach[i, room - n * x]:
                    for rest in self.exactly(room - n * x, i, 0, short_first):
                        yield [x] * n + rest

    def fillings(self, short_first: bool = False) -> Iterator[tuple[int, list[int] | None]]:
        """``(waste, lengths)`` around the longest piece left, least waste
        first; None for one that another one dominates (Martello and Toth: a
        piece in stock that still fits in place of one or several of them is
        never worse there)."""
        top = int(np.flatnonzero(self.left)[-1])
        self.left[top] -= 1
        have = np.where(self.left > 0, np.arange(self.capacity + 1), 0)
        self.left[top] += 1
        room, i = self.capacity - top, int(np.searchsorted(self.lengths, top))
        # kept while the search is below this filling, so no longer and no wider than needed
        longest = np.maximum.accumulate(have[:room + 1]).astype(np.int32)  # the longest piece of at most that length
        del have
        if longest[room] == room:
            yield 0, [top, room] if room else [top]
            return
        size = np.arange(room + 1)
        short = np.cumsum(self.left[:room + 1] * size) - np.where(size < top, 0, top)
        short = np.minimum(short, self.capacity + 1).astype(np.int32)
        del size
        self.know(i + 1)
        sums = np.flatnonzero(self.reach[i + 1, :room + 1])[::-1].astype(np.int32)
        for total in map(int, sums):
            waste = room - total
            if short[waste] > total:
                return  # no filling of this sum holds all pieces that still fit beside it
            for items in self.exactly(total, i + 1, 1 if top <= total else 0, short_first):
                yield waste, None if dominated(items, waste, longest, self.left, top) else [top, *items]


def dominated(items: list[int], waste: int, longest: np.ndarray, left: np.ndarray, top: int) -> bool:
    """Whether a piece in stock fits beside ``items``, or in place of one, two
    or all of them and is longer than the one, or as long as the several, it
    replaces."""
    kinds = sorted(set(items))
    several = {a + b for n, a in enumerate(kinds) for b in kinds[n:] if a < b or items.count(a) > 1}
    several |= {sum(items)} if len(items) > 2 else set()
    for sums, least in (({0, *items}, 1), (several, 0)):
        for s in sums:
            y = int(longest[min(s + waste, len(longest) - 1)])
            if y >= s + least and left[y] > items.count(y) + (y == top):
                return True
    return False


def dive(stock: np.ndarray, capacity: int, short_first: bool) -> tuple[list[tuple[dict[int, int], int]], int]:
    """The first filling each time, as often as the stock lasts, and how many
    fillings were looked at."""
    rest, plan, looks = Stock(stock, capacity), [], 0
    while rest.left.any():
        for _, items in rest.fillings(short_first):
            looks += 1
            if items:
                break
        uses = {x: items.count(x) for x in items}
        times = min(int(rest.left[x]) // n for x, n in uses.items())
        rest.take(uses, times)
        plan.append((uses, times))
    return plan, looks


class Packing(NamedTuple):
    """``bins``: (uses of each length, times); no packing has fewer than
    ``bound`` sequences; ``ended``: the search proved that none is better, or
    met ``bound``."""

    bins: list[tuple[dict[int, int], int]]
    bound: int
    ended: bool

    @property
    def size(self) -> int:
        return sum(times for _, times in self.bins)


def complete(stock: np.ndarray, capacity: int, best: list[tuple[dict[int, int], int]], bound: int, max_nodes: int,
             short_first: bool) -> tuple[list[tuple[dict[int, int], int]], bool]:
    """Depth-first bin completion from the incumbent ``best``: the best plan
    found, and whether the search came to its end within ``max_nodes``."""
    rest, total = Stock(stock, capacity), int((stock * np.arange(capacity + 1)).sum())
    size = lambda p: sum(p_[1] for p_ in p)
    choices = lambda: ((w, items, None) for w, items in rest.fillings(short_first))
    path, levels, seen = [], [choices()], {}
    used = waste = nodes = 0
    most = size(best)
    while levels and most > bound:
        if len(path) == len(levels):  # take back what this level tried last
            uses, times, each = path.pop()
            rest.take(uses, -times)
            used, waste = used - times, waste - times * each
            again = [(each, [x for x, n in uses.items() for _ in range(n)], times - 1)] if times > 1 else []
            levels[-1] = chain(again, levels[-1])
        each, items, times = next(levels[-1], (inf, None, None))
        allowed = (most - 1) * capacity - total
        if waste + each > allowed:  # the rest of the level wastes no less
            levels.pop()
            continue
        nodes += 1
        if nodes > max_nodes:
            return best, False
        if items is None:
            continue
        uses = {x: items.count(x) for x in items}
        times = times or min(int(rest.left[x]) // n for x, n in uses.items())
        if each:
            times = min(times, (allowed - waste) // each)
        rest.take(uses, times)
        used, waste = used + times, waste + times * each
        path.append((uses, times, each))
        if not rest.left.any():
            best, most = [(u, t) for u, t, _ in path], used
            continue
        state = hash(rest.left.tobytes())
        if seen.get(state, used + 1) <= used or used + lower_bound(rest.left, capacity) >= most:
            continue
        seen[state] = used
        levels.append(choices())
    return best, True


def refill(best: list[tuple[dict[int, int], int]], capacity: int, bound: int, max_nodes: int,
           max_looks: int) -> list[tuple[dict[int, int], int]]:
    """Better incumbents: a few sequences at a time, mostly those that waste
    much, are emptied and completed anew, as many copies at once as there are.
    The new ones replace them if they are fewer or, if as many, fuller at the
    front, which gathers the waste until a sequence is saved.  Ends at
    ``bound`` or after ``max_looks`` fillings looked at."""
    rng, looks, r = np.random.default_rng(0), 0, 0
    stored: dict[tuple, int] = {}
    for uses, times in best:
        key = tuple(sorted(uses.items()))
        stored[key] = stored.get(key, 0) + times
    fill = lambda key: sum(x * n for x, n in key)
    keys, times = list(stored), np.array(list(stored.values()), np.int64)
    at = {key: i for i, key in enumerate(keys)}
    waste = np.array([capacity - fill(key) for key in keys], np.int64)
    while looks < max_looks and int(times.sum()) > bound:
        r += 1
        live = np.flatnonzero(times)
        weight = np.minimum(times[live], 32) * (waste[live] + capacity / 256)
        some = min(int(rng.integers(3, 25)), int(times.sum()))
        chosen, count = np.unique(rng.choice(live, some, p=weight / weight.sum()), return_counts=True)
        count = np.minimum(count, times[chosen])
        n, copies = int(count.sum()), int((times[chosen] // count).min())
        stock = np.zeros(capacity + 1, np.int64)
        for i, c in zip(chosen.tolist(), count.tolist()):
            for x, k in keys[i]:
                stock[x] += k * c
        (new, some), low = dive(stock, capacity, bool(r % 2)), lower_bound(stock, capacity)
        looks += some
        if low < n <= sum(t for _, t in new):
            less, _ = complete(stock, capacity, [(dict(keys[i]), c) for i, c in zip(chosen.tolist(), count.tolist())], low,
                               max_nodes, bool(r % 2))
            looks += max_nodes
            if sum(t for _, t in less) < n:
                new = less
        size, full = sum(t for _, t in new), sum(t * fill(u.items()) ** 2 for u, t in new)
        if size > n or size == n and full <= sum(c * fill(keys[i]) ** 2 for i, c in zip(chosen.tolist(), count.tolist())):
            continue
        times[chosen] -= count * copies
        for uses, t in new:
            key = tuple(sorted(uses.items()))
            if key not in at:
                at[key] = len(keys)
                keys.append(key)
                times, waste = np.append(times, 0), np.append(waste, capacity - fill(key))
            times[at[key]] += t * copies
    return [(dict(keys[i]), int(times[i])) for i in np.flatnonzero(times)]


def plan_bins(stock: np.ndarray, capacity: int, max_nodes: int = MAX_NODES, max_looks: int = MAX_LOOKS) -> Packing:
    """Sequences for all pieces in ``stock[length]``."""
    stock = stock.astype(np.int64).copy()
    full = [({capacity: 1}, int(stock[capacity]))] if stock[capacity] else []
    whole, stock[capacity] = int(stock[capacity]), 0
    if not stock.any():
        return Packing(full, whole, True)
    rest = Stock(stock, capacity)
    rest.know(len(rest.lengths))
    capacity = int(np.flatnonzero(rest.reach[-1])[-1])  # no sequence can be fuller than that
    stock = stock[:capacity + 1]
    bound = lower_bound(stock, capacity)
    best, ended = best_fit(stock, capacity), False
    size = lambda p: sum(times for _, times in p)
    if size(best) > bound:
        best = refill(best, capacity, bound, max_nodes // 40, max_looks)
    for short_first in (False, True):
        if size(best) > bound and not ended:
            best, ended = complete(stock, capacity, best, bound, max_nodes, short_first)
    return Packing(full + best, whole + bound, ended or size(best) == bound)


def plan_runs(plan: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """Runs of piece numbers: the pieces ``first ..`` of ``length`` go ``uses``
    at a time into sequences ``base, base + 1, ...`` from ``offset`` on."""
    rows, base, taken = [], 0, {}
    for uses, times in plan:
        offset = 0
        for length, n in sorted(uses.items(), reverse=True):
            rows.append((length, taken.get(length, 0), n, base, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "uses", "base", "offset"]).astype("int64")


# ------------------------------------------------------------- the placement

def number_within_length(pieces: DataFrame, rows_per_salt: int = 100_000) -> DataFrame:
    """Add ``__rank``: 0, 1, ... among the pieces of the same length."""
    salts = max(64, -(-pieces.count() // rows_per_salt))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("__uid"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__salt", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__uid")) - 1
    return (salted.withColumn("__n", own).join(starts, ["length", "__salt"])
            .withColumn("__rank", F.col("__start") + F.col("__n")))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> DataFrame:
    """Add ``sequence_id, offset, gap`` to rows with ``length`` (1 to
    ``capacity``); ``gap``: sequences above the proven lower bound, or 0 where
    the search proved that none is better."""
    own = list(pieces.columns)
    pieces = cut(pieces.withColumn("__uid", F.monotonically_increasing_id()))
    stock = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        stock[r["length"]] = r["n"]
    plan = plan_bins(stock, capacity, max_nodes)
    give_back()  # what the search used, on the driver
    gap = 0 if plan.ended else plan.size - plan.bound
    runs = plan_runs(plan.bins).sort_values(["length", "first"])
    span = 1 << 44
    starts = (runs["length"] * span + runs["first"]).to_numpy()
    first, uses, base, offset = (runs[c].to_numpy() for c in ("first", "uses", "base", "offset"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            length, rank = part["length"].to_numpy(), part["__rank"].to_numpy()
            at = np.searchsorted(starts, length * span + rank, "right") - 1
            j = rank - first[at]
            yield part[own].assign(sequence_id=base[at] + j // uses[at], offset=offset[at] + j % uses[at] * length,
                                     gap=gap)

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in own]
                    + ["sequence_id long", "offset long", "gap long"])
    return number_within_length(pieces).select(*own, "__rank").mapInPandas(place, ddl)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return pack_pieces(cut_pieces(docs, **how), how.get("capacity", CAPACITY))
