"""Helpers shared by the iterative operators.

* :func:`cut` materialises a frame as a written table (shared folder,
  survives executor loss) and returns a frame with a one-node lineage;
  :func:`release` deletes such a table once its successor is written.
* :func:`salted_join` joins a large table to a per-key table and spreads the
  rows of hot keys over salts, without an action and without relying on AQE.
* :func:`split_hub_join` joins a large table to a per-key table where a few
  keys may carry a large share of the rows: heavy keys go through a
  broadcast whose row count is bounded by construction, the rest through a
  normal shuffle join.
* :func:`dense_index` numbers rows 0..n-1 in a global order without a
  single-partition window (range partitioning + per-partition offsets); its
  partitions grow with the counted rows and bytes.
* :func:`bucketed` writes a table clustered by keys, so later joins and
  aggregates on them read it in place.
"""

from __future__ import annotations

import math
import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import remove_path, scratch_path

_POS_MASK = (1 << 33) - 1
#: A key with more rows than this is spread over salts of about so many rows.
HOT_ROWS = 1_000_000
#: So many of the heaviest keys are spread: the bound of the broadcast.
MAX_HOT = 100_000
#: Classes of keys (by hash; a power of two) that are counted to find the heavy ones.
KEY_CLASSES = 1 << 16
#: A partition of a global index has about so many rows at most.
PART_ROWS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once as a parquet table under the session's shared
    checkpoint folder and return a scan of it: a one-node lineage that
    survives executor loss, stored columnar and compressed, and carrying no
    plan baggage from the rounds before it (a scan of files, nothing else)."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Delete the tables of frames made by :func:`cut`: call it when all that
    reads them is written.  Other frames are left alone."""
    for f in frames:
        path = getattr(f, "_scratch", None) if f is not None else None
        if path:
            remove_path(f.sparkSession, path)


def salted_join(big: DataFrame, small: DataFrame, on: str | list[str], spread: str, how: str = "inner",
                counted: DataFrame | None = None) -> DataFrame:
    """Join ``big`` to ``small`` (at most one row per key) on ``on``; ``how`` is
    ``inner``, ``left``, ``left_semi`` or ``left_anti``.

    The :data:`MAX_HOT` heaviest keys with more than :data:`HOT_ROWS` rows of
    ``big`` (partial aggregate; ties by key) are spread over
    ``ceil(rows / HOT_ROWS)`` salts by a hash of the column ``spread``, and
    their rows of ``small`` are repeated once per salt.  Every other key has at
    most ``max(HOT_ROWS, |big| / MAX_HOT)`` rows.  The table of hot keys is
    broadcast and has at most ``MAX_HOT`` rows.  Rows equal in ``spread`` share
    a salt.  ``counted``: a table whose rows per key are at least those of
    ``big`` (what ``big`` was derived from), to count that one instead.

    Where that table (or ``big``) was written by :func:`cut` and has at most
    ``HOT_ROWS`` rows in all, no key can be hot: the plain join is returned.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if few_rows(big if counted is None else counted):
        return big.join(small, keys, how)
    rows = F.col("__rows")
    hot = F.broadcast(_rows_of_hot_keys(big if counted is None else counted, keys).orderBy(rows.desc(), *keys).limit(MAX_HOT)
                      .select(*keys, F.ceil(rows / F.lit(HOT_ROWS)).cast("int").alias("__salts")))
    salt = F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__salts")))
    left = big.join(hot, keys, "left").select(*big.columns, salt.cast("int").alias("__salt"))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt")
    right = small.join(hot, keys, "left").select(*small.columns, each)
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def _rows_of_hot_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, __rows)`` of the keys with more than :data:`HOT_ROWS` rows.

    Rows are first counted by a hash of the key: :data:`KEY_CLASSES` numbers at
    most leave a task, where nearly every row would with its key.  Only classes of
    more than ``HOT_ROWS`` rows can hold such a key (there are at most
    ``rows / HOT_ROWS`` of them), so only their keys are counted.
    """
    # never null, so that no filter on it goes down to what ``table`` shares with other branches
    of = F.xxhash64(*keys).bitwiseAND(F.lit(KEY_CLASSES - 1)).alias("__class")
    rows = F.col("__rows")
    full = (table.select(of).groupBy("__class").agg(F.count(F.lit(1)).alias("__rows"))
            .filter(rows > F.lit(HOT_ROWS)).select("__class"))
    return (table.select(*keys, of).join(F.broadcast(full), "__class", "left_semi")
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).filter(rows > F.lit(HOT_ROWS)))


def few_rows(table: DataFrame, most: int | None = None) -> bool:
    """Whether a table written by :func:`cut` has at most ``most``
    (:data:`HOT_ROWS`) rows (file footers tell, no column is read).  Other frames
    are not computed for it."""
    return getattr(table, "_scratch", None) is not None and table.count() <= (HOT_ROWS if most is None else most)


def known_ends(edges: DataFrame, ids: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``(src, dst)`` rows of ``edges`` whose two ends are in ``ids.id``
    (duplicates kept): two semi joins with hot ends spread over salts.
    ``counted``: what ``edges`` was derived from, row by row (:func:`salted_join`).

    Ids written by :func:`cut`, at most a tenth of :data:`HOT_ROWS`, are broadcast: the
    edges then stay where they are, whatever their keys, and none are counted."""
    if few_rows(ids, HOT_ROWS // 10):
        near = F.broadcast(ids.select("id"))
        both = edges.select("src", "dst").join(near.withColumnRenamed("id", "src"), "src", "left_semi")
        return both.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
    ids, counted = ids.select("id"), edges if counted is None else counted
    src_known = salted_join(edges.select("src", "dst"), ids.withColumnRenamed("id", "src"), "src", "dst", "left_semi",
                            counted=counted)
    return salted_join(src_known, ids.withColumnRenamed("id", "dst"), "dst", "src", "left_semi",
                       counted=counted).select("src", "dst")


def resident_partitions(spark, rows: int, rows_per_partition: int = 2_000_000,
                        partitions: int | None = None) -> int:
    """Partition count for a table kept resident across rounds: one for each
    ``rows_per_partition`` rows, without an upper limit, and at least the
    smaller of the default parallelism and ``spark.sql.shuffle.partitions``
    (AQE does not coalesce a cached plan, so the count is chosen here, from a
    counted size)."""
    if partitions:
        return int(partitions)
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-rows // rows_per_partition))


def bounded_threshold(total_weight: int, floor: int, max_heavy: int) -> int:
    """A per-key weight threshold such that at most ``max_heavy`` keys can
    exceed it when the weights sum to ``total_weight``."""
    return max(int(floor), int(math.ceil(total_weight / max(1, max_heavy))))


def split_hub_join(big: DataFrame, small: DataFrame, key: str, weight: str,
                   threshold: int, total_weight: int | None = None, *, moved: bool = False) -> DataFrame:
    """Inner join ``big`` and ``small`` on ``key`` (``small`` has one row per key
    and a column ``weight`` = number of ``big`` rows of that key).

    Keys heavier than ``threshold`` are answered by a broadcast hash join:
    their number is below ``sum(weight) / threshold`` (see
    :func:`bounded_threshold`), so the broadcast side has a proven bound.  The
    remaining keys carry at most ``threshold`` rows each and take a shuffle
    join, where no task gets more than one light key's rows per key.
    When ``total_weight`` (the row count of ``big``) is at most ``threshold``
    no key can be heavy and the plain join is returned.  ``moved``: light keys
    are shuffled even where Spark would send ``small``'s files, which compress
    well, through the driver.
    """
    def sent(frame: DataFrame) -> DataFrame:
        return frame.hint("merge") if moved else frame

    if total_weight is not None and total_weight <= threshold:
        return big.join(sent(small), key)
    small_cols = [c for c in small.columns if c != key]
    hubs = small.filter(F.col(weight) > F.lit(threshold))
    rest = small.filter(F.col(weight) <= F.lit(threshold))
    marked = big.join(F.broadcast(hubs.select(key, *[F.col(c).alias(f"__hub_{c}") for c in small_cols])),
                      key, "left")
    probe = f"__hub_{weight}"
    hot = marked.filter(F.col(probe).isNotNull()).select(
        *big.columns, *[F.col(f"__hub_{c}").alias(c) for c in small_cols])
    cold = marked.filter(F.col(probe).isNull()).select(*big.columns).join(sent(rest), key)
    return hot.unionByName(cold.select(*big.columns, *small_cols))


def bucketed(df: DataFrame, keys: list[str], buckets: int, *, cluster: bool = True) -> DataFrame:
    """Write ``df`` once as a parquet table bucketed by ``keys`` under the shared
    checkpoint folder and return a scan of it.

    Joins and aggregates on the keys read the buckets in place (no exchange
    of this side), and a lost executor reads the files again.  ``cluster``: move
    each key's rows to one task first, so a bucket is one file; without it every
    task writes the buckets that it holds.  Delete it with :func:`release`.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "buckets")
    name = os.path.basename(path).replace("-", "_")
    rows = df.repartition(buckets, *keys) if cluster else df
    rows.write.option("path", path).bucketBy(buckets, *keys).saveAsTable(name)
    out = spark.table(name)
    out.schema                     # resolved now: the scan needs the catalog no more
    spark.sql(f"DROP TABLE {name}")
    out._scratch = path
    return out


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value; a null has none."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, T.StructType):
        size = reduce(Column.__add__, [_value_bytes(value[f.name], f.dataType) for f in kind], F.lit(0).cast("long"))
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        size = F.size(value).cast("long") * F.lit(16)
    else:
        return F.lit(8).cast("long")
    return F.coalesce(size, F.lit(0).cast("long"))


def table_size(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of ``df``, counted in one pass."""
    each = reduce(Column.__add__, [_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema],
                  F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(each), F.lit(0))).first()
    return int(row[0]), int(row[1])


def sized_partitions(spark, rows: int, size: int) -> int:
    """Partitions of at most about :data:`PART_ROWS` rows and the bytes that a
    scan's task reads (``spark.sql.files.maxPartitionBytes``, which says what a
    task of this cluster may hold), without an upper limit on their number."""
    number, unit = re.fullmatch(r"(\d+)([a-z]*)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    most = int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit[:1], 0)
    return max(resident_partitions(spark, rows, PART_ROWS), -(-size // max(1, most)))


def dense_index(df: DataFrame, order: list[Column], name: str = "idx",
                partitions: int | None = None, *, spread_ties: bool = False) -> DataFrame:
    """Add ``name`` = position (0-based, bigint) of each row in ``order``.

    Rows are range-partitioned on the full sort key (a large group spreads
    over several partitions), sorted inside each partition, materialised,
    and shifted by the row count of all earlier partitions.  The number of
    partitions follows from counted rows and bytes (one more pass over
    ``df``, without its computed columns of fixed width), so a partition's size
    does not grow with the table.  The offset table has one row per partition,
    so its broadcast is bounded.

    ``spread_ties``: rows that agree in the whole sort key (one row repeated)
    are spread too, by the row's own number.  ``df`` must then be a scan of
    files and what follows from each of its rows alone, so that a task that
    runs again numbers its rows alike.
    """
    spark = df.sparkSession
    n = partitions or sized_partitions(spark, *table_size(df))
    rows, keys = (df.withColumn("__own", F.monotonically_increasing_id()), [*order, F.col("__own")]) if spread_ties \
        else (df, order)
    s = (rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__own")
           .withColumn("__pid", F.spark_partition_id())
           .withColumn("__pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))))
    s = cut(s)
    counts = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = s.join(F.broadcast(offsets), "__pid").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__off") + F.col("__pos")).cast("long").alias(name))
    out._scratch = s._scratch        # what release() of the result deletes
    return out
