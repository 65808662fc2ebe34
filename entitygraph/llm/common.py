"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import cut, dense_index  # noqa: F401  (re-exported)
from ..session import give_back, ship_package  # noqa: F401  (re-exported)

#: Bytes that separate words: space and \t \n \v \f \r (what bytes.split() splits on).
ASCII_SPACE = b" \t\n\r\x0b\x0c"


#: Whole texts go to Python workers, so batches are kept to so many rows.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Prepare a session for these operators: short Arrow batches, and this
    package for the Python workers (as ``--py-files`` does, once per
    application: they need not have been started where it is installed)."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


def in_chunks(frames: Iterator[pd.DataFrame], text: str, max_chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut batches so that one chunk holds at most about ``max_chars``
    characters of ``text`` (or a single row), which bounds a task's memory
    however long the texts are."""
    try:
        yield from _chunks(frames, text, max_chars)
    finally:
        give_back()


def _chunks(frames: Iterator[pd.DataFrame], text: str, max_chars: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if not len(frame):
            continue
        size = frame[text].map(len, na_action="ignore").fillna(0).to_numpy().astype(np.int64)
        group = (np.cumsum(size) - size) // max_chars
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            yield frame.iloc[a:b]


def is_text(value) -> bool:
    return isinstance(value, str)


def hash_words(words: list[bytes], seed: int = 0) -> np.ndarray:
    """One 64-bit hash per word."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` consecutive words."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    out = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15, np.uint64)
    for j in range(k):
        out = (out ^ h[j:len(h) - k + 1 + j]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
    return out
