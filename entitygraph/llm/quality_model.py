"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is a number measured on the whole text and put into one of at
most ``BINS`` bins (quantiles of the training sample).  Training boosts shallow
trees cyclically: in each round every feature in turn gets one small tree (two
levels of splits over its bins) fitted to the gradient of the log loss, whose
steps are added to that feature's lookup table; then the pairs of features that
explain most of what is left get two-dimensional tables the same way.  Scoring
is a sum of table entries, vectorised over a batch: bin numbers by
``searchsorted``, one gather per table.

The model is fitted on the driver on at most ``MAX_SAMPLE`` labelled documents
(the smallest hashes of their ids); measuring them and scoring all documents
runs in Spark tasks.  Only the text is an input of the score.

Defined cases: null text counts as empty and gets a score like any other; a
null id cannot be labelled and is not held out; an id with several labels takes
their majority (ties: 1); an id with several texts trains on the first by hash;
without labelled rows every score is 0.5, with one label only it is that
label's smoothed rate; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, fold, in_chunks, is_text
from .quality_rules import repeat_words

#: At most so many labelled documents are brought to the driver (features only).
MAX_SAMPLE = 20_000
FOLDS, HELD_OUT = 3, 1
BINS = 32
ROUNDS, PAIR_ROUNDS, PAIRS = 250, 100, 8
RATE = 0.1
MIN_LEAF = 5.0

_CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "stop": b".,;:?", "shout": b"!",
    "bar": b"|", "symbol": b"#*$%&<>", "other_punct": b"\"'()-/+=@[]\\^_`{}~", "newline": b"\n", "wide": range(192, 256),
    "wide_upper": range(128, 159),
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes), _i] = 1.0

FEATURES = ["words", "distinct", "word_length", "longest", "adjacent", "repeated", "line_words", "dup_lines",
            "short_words", *_CLASSES]


def features(text: str | None) -> list[float]:
    """The features of one text (null: empty text)."""
    raw = text.encode("utf-8", "surrogatepass") if is_text(text) else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lines = [x for x in raw.split(b"\n") if x.strip(ASCII_SPACE)]
    sizes = np.fromiter(map(len, words), np.int64, n)
    adjacent = sum(a == b for a, b in zip(words, words[1:]))
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF / int(sizes.sum())
    return [np.log1p(n), len(set(words)) / n, sizes.mean(), np.log1p(sizes.max()), adjacent / n,
            repeat_words(words) / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
            float((sizes <= 3).mean()), *share]


def _boost_tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, size: int) -> np.ndarray:
    """Steps per bin of a tree with two levels of splits over one feature."""
    g, h = np.bincount(bins, grad, size), np.bincount(bins, hess, size)
    return _steps(g, h, 2)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of ordered bins (0: none)."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    tg, th = g.sum(), h.sum()
    ok = (ch >= MIN_LEAF / 4) & (th - ch >= MIN_LEAF / 4)
    gain = np.where(ok, cg ** 2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg ** 2 / (th + 1), 0.0)
    i = int(np.argmax(gain))
    return (float(gain[i]), i + 1) if gain[i] > 1e-9 else (0.0, 0)


def _steps(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    at = _split(g, h)[1] if depth else 0
    if not at:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([_steps(g[:at], h[:at], depth - 1), _steps(g[at:], h[at:], depth - 1)])


def _pair_steps(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of a two-dimensional tree: one split along the better
    axis, then one along the other axis on each side."""
    best, out = 0.0, np.full(g.shape, -g.sum() / (h.sum() + 1))
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        _, at = _split(gg.sum(1), hh.sum(1))
        for cut in {at, gg.shape[0] // 2} - {0}:
            steps, total = np.empty(gg.shape), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[side].sum(0), hh[side].sum(0)
                gain, _ = _split(sg, sh)
                total += gain + sg.sum() ** 2 / (sh.sum() + 1)
                steps[side] = _steps(sg, sh, 1)
            total -= gg.sum() ** 2 / (hh.sum() + 1)
            if total > best:
                best, out = total, steps if axis == 0 else steps.T
    return best, out


class Additive:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, intercept: float, edges: list[np.ndarray], tables: list[np.ndarray],
                 pairs: list[tuple[int, int, np.ndarray]]):
        self.intercept, self.edges, self.tables, self.pairs = intercept, edges, tables, pairs

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for j, k, t in self.pairs:
            z += t[b[:, j], b[:, k]]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fit the tables; every fifth row decides when to stop."""
    f = x.shape[1]
    if not len(y):
        return Additive(0.0, [np.empty(0)] * f, [np.zeros(1)] * f, [])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(f)]
    model = Additive(intercept, edges, [np.zeros(len(e) + 1) for e in edges], [])
    if y.min() == y.max():
        return model
    b = model.bins(x)
    watch = np.arange(len(y)) % 5 == 4 if len(y) >= 200 else np.zeros(len(y), bool)
    z = np.full(len(y), intercept)
    weight = (~watch).astype(float)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return (p - y) * weight, p * (1 - p) * weight

    def loss():
        own = watch if watch.any() else ~watch
        return float(np.mean(np.logaddexp(0, np.where(y[own] == 1, -z[own], z[own]))))

    best, since = (loss(), 0, [t.copy() for t in model.tables]), 0
    for _ in range(ROUNDS):
        for j in range(f):
            g, h = slopes()
            step = RATE * _boost_tree(b[:, j], g, h, len(model.tables[j]))
            model.tables[j] += step
            z += step[b[:, j]]
        now = loss()
        if now < best[0] - 1e-6:
            best, since = (now, 0, [t.copy() for t in model.tables]), 0
        else:
            since += 1
            if since >= 15:
                break
    model.tables = best[2]
    z = intercept + sum(t[b[:, j]] for j, t in enumerate(model.tables))

    def grids(j, k):
        g, h = slopes()
        shape = (len(edges[j]) + 1, len(edges[k]) + 1)
        cell = b[:, j] * shape[1] + b[:, k]
        return (np.bincount(cell, g, shape[0] * shape[1]).reshape(shape),
                np.bincount(cell, h, shape[0] * shape[1]).reshape(shape))

    ranked = sorted(((_pair_steps(*grids(j, k))[0], j, k) for j in range(f) for k in range(j)), reverse=True)[:PAIRS]
    pairs = [[j, k, np.zeros((len(edges[j]) + 1, len(edges[k]) + 1))] for gain, j, k in ranked if gain > 0]
    best, since = (loss(), [t.copy() for *_, t in pairs]), 0
    for _ in range(PAIR_ROUNDS):
        for p in pairs:
            step = RATE * _pair_steps(*grids(p[0], p[1]))[1]
            p[2] += step
            z += step[b[:, p[0]], b[:, p[1]]]
        now = loss()
        if now < best[0] - 1e-6:
            best, since = (now, [t.copy() for *_, t in pairs]), 0
        else:
            since += 1
            if since >= 10:
                break
    model.pairs = [(j, k, t) for (j, k, _), t in zip(pairs, best[1])]
    return model


def _measured(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``kept`` and the features of ``__text`` as one array."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_chunks(frames, "__text"):
            yield part[kept].assign(x=[np.asarray(features(t), float) for t in part["__text"]])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInPandas(run, f"{ddl}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality",
          max_sample: int = MAX_SAMPLE) -> Additive:
    """Fit on the labelled rows outside the held-out fold."""
    known = (labels.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("y"))
             .filter(F.col("__key").isNotNull() & F.col("y").isNotNull() & (fold("__key", FOLDS) != HELD_OUT))
             .groupBy("__key").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    # the sample's ids are drawn before its documents are read: at most
    # max_sample rows, so they are broadcast
    ids = docs.select(F.col(key).alias("__key")).join(known, "__key", "left_semi").distinct()
    drawn = known.join(ids, "__key").orderBy(F.xxhash64("__key"), "__key").limit(max_sample)
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__key")
    first = _measured(rows, ["__key", "y"]).groupBy("__key", "y").agg(F.min("x").alias("x"))
    got = first.orderBy("__key").toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(float))


def score_documents(docs: DataFrame, model: Additive, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, score, predicted`` of every document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_chunks(frames, "__text"):
            x = np.array([features(t) for t in part["__text"]], float).reshape(len(part), len(FEATURES))
            yield pd.DataFrame({"__key": part["__key"].array, "score": model.score(x)})

    kind = docs.schema[key].dataType.simpleString()
    got = (docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
           .mapInPandas(run, f"__key {kind}, score double"))
    return got.select(F.col("__key").alias(key),
                      F.coalesce(fold("__key", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
