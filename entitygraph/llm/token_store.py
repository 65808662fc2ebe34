"""Token-id output: raw id shards with a minimal perfect hash index.

Layout of a store (a folder on the shared file system):

* ``ids-00000.bin``   ids of the shard's documents one after the other, each
  closed with the end id: little-endian unsigned 16-bit (32-bit where the
  vocabulary needs it), no header.  Documents ascend by id over all shards.
* ``rows-00000.bin``  number of ids of each document of the shard: u32.
* ``index-00000.bin`` one hash bucket of the keyed index.

Index: a key goes to a bucket by hash; in the bucket a minimal perfect hash
(bit arrays by level: a key sits at the first level where it is alone on its
bit; its number is the rank of that bit) gives a slot without storing keys; the
slot holds a fingerprint, against strange keys, and the key's runs.  A run is a
key's consecutive rows in one shard: shard, first row, rows, first id, ids.  So
a lookup costs a constant number of probes, and a key repeated in a third of
all rows is a few runs.

Tasks write to a temporary name and move it into place, so a task that runs
again overwrites its own files with the same content.

Defined cases: null or empty text is the end id alone; rows with the same id
follow one another by hash of text and are one key's runs; a null id is stored
under the lowest long and comes first; an empty table gives an empty store;
other columns are ignored.  Ids must be integers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import cut, in_chunks
from .tokens import encoder

END_ID = 0
SHARD_TEXT_BYTES = 32 << 20
BUCKET_RUNS = 50_000
LOWEST = -(1 << 63)
_GAMMA = 2.0
_RUN = np.dtype([("shard", "<u4"), ("first_row", "<u4"), ("rows", "<u4"), ("offset", "<u8"), ("tokens", "<u8")])


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(base: str, name: str, chunks) -> None:
    system, root = _open(base)
    system.create_dir(root, recursive=True)
    tmp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(tmp) as out:
        for c in chunks:
            out.write(c)
    system.move(tmp, f"{root}/{name}")


def _read(base: str, name: str) -> bytes:
    system, root = _open(base)
    with system.open_input_file(f"{root}/{name}") as f:
        return f.read()


# ------------------------------------------------------- minimal perfect hash

def mix(key: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scramble of 64-bit keys (splitmix64 with a seed)."""
    z = key.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays (one bool per position) of the levels for distinct keys."""
    levels, left = [], keys
    while len(left):
        size = max(1, int(_GAMMA * len(left)))
        at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit (a strange key may also
    meet another key's slot; the fingerprint tells)."""
    out = np.full(len(keys), -1, np.int64)
    before = 0
    for i, bits in enumerate(levels):
        todo = np.flatnonzero(out < 0)
        if not len(todo):
            break
        at = (mix(keys[todo], i) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        before += int(bits.sum())
    return out


def _pack_index(levels, prints, first, runs) -> bytes:
    head = struct.pack("<4sIII", b"MPH1", len(levels), len(prints), len(runs))
    body = b"".join(struct.pack("<Q", len(x)) + np.packbits(x).tobytes() for x in levels)
    return head + body + prints.astype("<u4").tobytes() + first.astype("<u4").tobytes() + runs.tobytes()


class Index:
    """One bucket of the index, read from its file."""

    def __init__(self, raw: bytes):
        magic, n_levels, n, n_runs = struct.unpack_from("<4sIII", raw)
        if magic != b"MPH1":
            raise ValueError("not an index file")
        at, self.levels = 16, []
        for _ in range(n_levels):
            (size,) = struct.unpack_from("<Q", raw, at)
            width = -(-size // 8)
            self.levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at + 8), count=size).astype(bool))
            at += 8 + width
        self.prints = np.frombuffer(raw, "<u4", n, at)
        self.first = np.frombuffer(raw, "<u4", n + 1, at + 4 * n)
        self.runs = np.frombuffer(raw, _RUN, n_runs, at + 4 * n + 4 * (n + 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one run of each key (equal: not stored)."""
        keys = keys.astype(np.int64).view(np.uint64)
        s = slots(self.levels, keys)
        known = s >= 0
        known[known] = self.prints[s[known]] == fingerprint(keys[known])
        s = np.where(known, s, 0)
        if not len(self.prints):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        a, b = self.first[s].astype(np.int64), self.first[s + 1].astype(np.int64)
        return a, np.where(known, b, a)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


# --------------------------------------------------------------------- write

class Store:
    """A written store: its folder, id type, buckets and shard sizes."""

    def __init__(self, path: str, width: str, buckets: int, shards: DataFrame):
        self.path, self.width, self.buckets, self.shards = path, width, buckets, shards


def write_store(docs: DataFrame, path: str, *, tokenizer: str, kind: str = "byte", text: str = "text",
                key: str = "doc_id", end_id: int = END_ID, width: str = "<u2",
                shard_text_bytes: int = SHARD_TEXT_BYTES) -> Store:
    """Encode and write all documents; returns the store."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-int(total) // shard_text_bytes))
    order = [F.col("key").asc(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    item = np.dtype(width).itemsize

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, keys, sizes = encoder(tokenizer, kind, width), [], []

        def payload():
            for part in in_chunks(frames, "text"):
                flat, size = enc.encode(part["text"])
                ends = np.cumsum(size) + np.arange(1, len(size) + 1)
                ids = np.full(len(flat) + len(size), end_id, width)
                body = np.ones(len(ids), bool)
                body[ends - 1] = False
                ids[body] = flat
                keys.append(part["key"].to_numpy())
                sizes.append(size + 1)
                yield ids.tobytes()

        _write(path, f"ids-{shard:05d}.bin", payload())
        if not keys:
            return
        k, n = np.concatenate(keys), np.concatenate(sizes)
        _write(path, f"rows-{shard:05d}.bin", [n.astype("<u4").tobytes()])
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        yield pd.DataFrame({"key": k[first], "shard": np.int64(shard), "first_row": first,
                            "rows": np.diff(np.append(first, len(k))), "offset": (np.cumsum(n) - n)[first],
                            "tokens": np.add.reduceat(n, first)})

    runs = cut(ranged.mapInPandas(run, "key long, shard long, first_row long, rows long, offset long, tokens long"))
    buckets = max(1, -(-runs.count() // BUCKET_RUNS))

    def index(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["key", "shard"])
        keys = g["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        own = keys[starts].view(np.uint64)
        levels = build_levels(own)
        slot = slots(levels, own)
        order_ = np.argsort(slot)
        sizes = np.diff(np.append(starts, len(keys)))[order_]
        runs_ = np.empty(len(g), _RUN)
        take = np.repeat(starts[order_] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(g))
        for c in _RUN.names:
            runs_[c] = g[c].to_numpy()[take]
        first = np.concatenate([[0], np.cumsum(sizes)])
        b = int(group["bucket"].iloc[0])
        _write(path, f"index-{b:05d}.bin", [_pack_index(levels, fingerprint(own)[order_], first, runs_)])
        return pd.DataFrame({"bucket": [b], "keys": [len(own)]})

    cut(runs.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(index, "bucket int, keys long"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = (runs.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
              .withColumn("base", F.coalesce(F.sum("tokens").over(w), F.lit(0))))
    return Store(path, width, buckets, cut(shards))


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------------- read

def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """Runs of every key (column ``key``, distinct) found through the index."""
    path = store.path

    def find(group: pd.DataFrame) -> pd.DataFrame:
        index = Index(_read(path, f"index-{int(group['bucket'].iloc[0]):05d}.bin"))
        own = group["key"].to_numpy()
        a, b = index.find(own)
        which = np.repeat(np.arange(len(own)), b - a)
        at = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(len(which))
        return pd.DataFrame({"key": own[which], **{c: index.runs[c][at].astype(np.int64) for c in _RUN.names}})

    return (keys.withColumn("bucket", bucket_of(store.buckets)).groupBy("bucket")
            .applyInPandas(find, "key long, shard long, first_row long, rows long, offset long, tokens long"))


def read_documents(store: Store, keys: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of every stored row of the keys, read
    from the shards at the offsets that the index gives."""
    path, width = store.path, np.dtype(store.width)

    def fetch(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        sizes = np.frombuffer(_read(path, f"rows-{shard:05d}.bin"), "<u4").astype(np.int64)
        system, root = _open(path)
        out = []
        with system.open_input_file(f"{root}/ids-{shard:05d}.bin") as f:
            for r in group.sort_values("offset").itertuples():
                f.seek(r.offset * width.itemsize)
                ids = np.frombuffer(f.read(r.tokens * width.itemsize), width).astype("<u4").tobytes()
                at = 0
                for n in sizes[r.first_row:r.first_row + r.rows].tolist():
                    out.append((r.key, shard, r.offset + at, n, zlib.crc32(ids[4 * at:4 * (at + n)])))
                    at += n
        return pd.DataFrame(out, columns=["key", "shard", "local", "n_tokens", "ids_crc32"])

    rows = lookup(store, keys).groupBy("shard").applyInPandas(
        fetch, "key long, shard long, local long, n_tokens long, ids_crc32 long")
    return rows.join(store.shards.select("shard", "base"), "shard").select(
        "key", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def encode_and_read_back(spark: SparkSession, docs: DataFrame, *, tokenizer: str, key: str = "doc_id", **how) -> DataFrame:
    store = write_store(docs, scratch_path(spark, "tokens"), tokenizer=tokenizer, key=key, **how)
    keys = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("key")).distinct()
    kind = docs.schema[key].dataType
    return read_documents(store, keys).select(
        F.when(F.col("key") != LOWEST, F.col("key")).cast(kind).alias(key), "start", "n_tokens", "ids_crc32")
