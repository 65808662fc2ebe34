"""Quality rules with a host-level verdict.

Every document is measured over its whole text and fails the base rules when
it has fewer than ``min_words`` words or more than ``max_repeat_pct`` percent
of its words lie in five-word windows that occur twice or more in it.  The
failures are then aggregated by host (the ``source`` column, or the host of a
url): each host's failure rate is shrunk towards the corpus rate with a beta
prior fitted to all hosts by moments, and documents of hosts whose shrunk rate
exceeds ``max_host_rate`` are rejected too.

Defined cases: null text counts as no text (fails: no words); an empty table
gives an empty result; a null or empty host is unknown and never rejected as
a host; repeated rows are measured and counted one by one; other columns of
the input are ignored by :func:`score_documents` and kept by
:func:`filter_documents` (whatever their names, except ``__base_failed`` and
``__host``, which are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, hash_words, in_chunks, is_text, window_hashes

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
#: A shrunk failure rate above this rejects the host.
MAX_HOST_RATE = 0.5
#: Rejected hosts up to this number are broadcast; beyond it the join shuffles.
BROADCAST_HOSTS = 10_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by ``window``-word runs that occur at least twice
    (the first occurrence included; runs may overlap)."""
    if len(words) <= window:
        return 0
    h = window_hashes(hash_words(words), window)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    rep = np.zeros(len(h), bool)
    rep[order[1:][same]] = True
    rep[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(rep)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    if not is_text(text) or not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    bare = raw.translate(None, ASCII_SPACE)
    chars = len(text) - (len(raw) - len(bare))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(ASCII_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeat_words(words)


def _measure_batches(text: str, keep: list[str]):
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_chunks(frames, text):
            got = np.array([measure(t) for t in part[text]], np.int64).reshape(len(part), len(names))
            yield part[keep].assign(**{n: got[:, i] for i, n in enumerate(names)})

    return run


def base_failed(min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))


def url_host(url: Column) -> Column:
    """Lower-case host of a url, for tables that have urls instead of a source."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def host_rates(flags: DataFrame, host: str, failed: str) -> DataFrame:
    """``host, n, failures, rate``: every known host's shrunk failure rate.

    With ``mu`` the corpus rate and ``K`` hosts, the between-host variance
    (weighted by documents) less its binomial part gives the prior strength
    ``M`` (kept within 1 and 1e6; 1e6 where hosts differ no more than chance);
    ``rate = (failures + M mu) / (n + M)``.
    """
    hosts = (flags.filter((F.col(host) != "") & F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("failures")))
    hosts = cut(hosts)
    one = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("failures").alias("f"),
                    F.sum(1.0 / F.col("n")).alias("inv"),
                    F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("sq")).first()
    mu, strength = prior(one["k"], one["n"] or 0, one["f"] or 0, one["inv"] or 0.0, one["sq"] or 0.0)
    return hosts.withColumn("rate", (F.col("failures") + F.lit(strength * mu)) / (F.col("n") + F.lit(strength)))


def prior(k: int, n: int, f: int, inv: float, sq: float) -> tuple[float, float]:
    """Mean and strength of the beta prior from sums over the hosts: their
    number, documents, failures, sum of 1/n and sum of failures^2/n."""
    if not n:
        return 0.0, 1.0
    mu = f / n
    if k < 2:
        return mu, 1e6
    between = max(0.0, sq - n * mu * mu) / n * k / (k - 1)
    excess = between - mu * (1 - mu) * inv / k
    if excess <= 0:
        return mu, 1e6
    return mu, min(1e6, max(1.0, (mu * (1 - mu) - between) / excess))


def rejected_hosts(flags: DataFrame, host: str, failed: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host`` of every host over the limit, marked for broadcast only when
    their counted number is at most ``BROADCAST_HOSTS``."""
    bad = host_rates(flags, host, failed).filter(F.col("rate") > max_host_rate).select(F.col("host").alias(host))
    return F.broadcast(bad) if bad.count() <= BROADCAST_HOSTS else bad


def score_documents(docs: DataFrame, *, text: str = "text", host: str = "source", key: str = "doc_id",
                    min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT,
                    max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Per document: key, the measures, ``base_failed`` and ``kept``."""
    rows = docs.select(F.col(key).alias("__key"), F.col(host).cast("string").alias("__host"),
                       F.col(text).alias("__text"))
    kind = docs.schema[key].dataType.simpleString()
    got = rows.mapInPandas(_measure_batches("__text", ["__key", "__host"]),
                           f"__key {kind}, __host string, {MEASURES}")
    got = cut(got.withColumn("base_failed", base_failed(min_words, max_repeat_pct)))
    bad = rejected_hosts(got, "__host", "base_failed", max_host_rate).withColumn("__bad", F.lit(True))
    return (got.join(bad, "__host", "left")
            .select(F.col("__key").alias(key), *[x.split()[0] for x in MEASURES.split(", ")], "base_failed",
                    (~F.col("base_failed") & F.col("__bad").isNull()).alias("kept"),
                    F.col("__bad").isNotNull().alias("host_rejected")))


def filter_documents(docs: DataFrame, *, text: str = "text", host: str = "source",
                     min_words: int = MIN_WORDS, max_repeat_pct: int = MAX_REPEAT_PCT,
                     max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with exactly their own columns."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_chunks(frames, text):
            got = np.array([measure(t) for t in part[text]], np.int64).reshape(len(part), 5)
            n, rep = got[:, 0], got[:, 4]
            yield part.assign(__base_failed=(n < min_words) | (100 * rep > max_repeat_pct * n))

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["__base_failed boolean"])
    got = cut(docs.mapInPandas(run, ddl).withColumn("__host", F.col(host).cast("string")))
    bad = rejected_hosts(got, "__host", "__base_failed", max_host_rate)
    # a null host compares with no host, so an anti-join keeps it
    return got.filter(~F.col("__base_failed")).join(bad, "__host", "left_anti").select(docs.columns)
