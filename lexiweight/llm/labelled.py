"""Bounded samples of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweight.llm.shared import saved, ship

# Partitions of a sample: tasks that turn it into features.
PARTITIONS = 6


def held_out(doc_id: Column) -> Column:
    """True for the fifth of all documents from which no label is learned; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """``(doc_id, text, label)`` for at most ``per_label`` training documents of each label, 0 and 1.

    The ids are those of the smallest hashes, so the choice depends on nothing else. Rows without
    an id or a label, and held-out ones, are left out; contradicting labels of a document are both
    taken.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    parts = [known.filter(F.col("label") == v).orderBy(order, "doc_id").limit(per_label) for v in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Repeated rows of one document count once.
    found = texts.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return saved(found.repartition(PARTITIONS, "doc_id"), "sample")
