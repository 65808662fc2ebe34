"""Corpus pipeline: rules, language, near-duplicates, mixing, packing.

``STAGES`` lists (name, function); each function takes ``(spark, docs,
sf_dir)`` and works on all documents that its predecessor kept.  All but the
last return the columns of ``documents``; the last returns one row per packed
piece.  ``run`` writes each stage's rows as Parquet under the shared checkpoint
folder and reads them again for the next, which also cuts the lineage.

The language stage learns from the ``lang`` column of its own input, so SQL
cannot express the result and ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entitygraph.llm import language, mixing, near_dups, packing, quality_rules
from entitygraph.llm.common import ship, table
from entitygraph.session import scratch_path

#: Near-duplicates here: shared five-word shingles, similarity of 0.8 or more.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    ship(spark)
    return quality_rules.filter_documents(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are surely in one of the learned languages."""
    ship(spark)
    return language.filter_documents(docs, language.train(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (the least id)."""
    ship(spark)
    return near_dups.drop_duplicates(docs, k=SHINGLE_WORDS, percent=SIMILARITY_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights draw them."""
    ship(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("language ID", languages), ("near-duplicates", distinct),
          ("mixing", mix), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
