"""Counting a collection in slices, whose saved counts add up to those of the whole.

A slice is a set of whole documents that is counted once. What is saved of it, its word counts,
document sizes and document frequencies, merges with that of other slices: documents that come later
are counted alone, and no text is read twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweight import operators as op
from lexiweight.plans.pipeline import term_counts

# The tables of a slice.
SCHEMAS = {
    "counts": "corpus string, document string, word string, word_count bigint, doc_size bigint",
    "documents": "corpus string, document string, doc_size bigint",
    "frequencies": "corpus string, word string, num_docs_with_word bigint",
}


def write_slice(corpus: DataFrame, path: str, profile: str = "raw") -> None:
    """Count the documents of ``corpus`` and save the three tables of the slice below ``path``.

    All rows of a document must be in the slice. A document without words is one of size 0. Each
    table is computed from the saved one before it; a slice that exists is replaced.
    """
    spark = corpus.sparkSession
    counts, _ = term_counts(corpus, profile)
    counts.write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.schema(SCHEMAS["counts"]).parquet(f"{path}/counts")
    op.document_frequency(counts).write.mode("overwrite").parquet(f"{path}/frequencies")
    none = op.keyed(corpus).select("corpus", "document", F.lit(0).cast("bigint").alias("word_count"))
    sizes = op.document_size(counts.select(*none.columns).unionByName(none))
    sizes.write.mode("overwrite").parquet(f"{path}/documents")


def _all(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    read = [spark.read.schema(SCHEMAS[table]).parquet(f"{path}/{table}") for path in paths]
    return reduce(DataFrame.unionByName, read)


def merged_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(corpus, document, doc_size)`` of all slices. A document that two slices have fails the query: its
    words would count in the frequencies of both."""
    found = _all(spark, paths, "documents").groupBy("corpus", "document")
    found = found.agg(F.sum("doc_size").alias("doc_size"), F.count(F.lit(1)).alias("slices"))
    message = F.concat(F.lit("several slices have the document "), F.col("document"))
    once = F.when(F.col("slices") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return found.filter(once).drop("slices")


def merged_size(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(corpus, num_docs)`` of all slices."""
    return merged_documents(spark, paths).groupBy("corpus").agg(F.count(F.lit(1)).alias("num_docs"))


def merged_frequency(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(corpus, word, num_docs_with_word)`` of all slices: the sums of theirs, as no document is in
    two of them, which is checked."""
    checked = merged_documents(spark, paths).agg(F.count(F.lit(1))).scalar()
    frequencies = _all(spark, paths, "frequencies").groupBy("corpus", "word")
    return frequencies.agg(F.sum("num_docs_with_word").alias("num_docs_with_word")).filter(checked >= 0)


def merged_weights(spark: SparkSession, paths: list[str], pieces: int | None = None) -> DataFrame:
    """``(corpus, document, word, tf, icf, score)`` of the documents of all slices, as if they had been
    counted together."""
    # Their sizes are whole, as no document is in two slices; the frequencies check it.
    parts = _all(spark, paths, "counts")
    table = op.word_table(merged_frequency(spark, paths), merged_size(spark, paths), pieces)
    return op.scores(op.spread_join(parts, table, ["corpus", "word"], pieces))
