"""Corpora from tables. A corpus is a DataFrame ``(corpus, document, text)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORPUS_COLUMNS = ["corpus", "document", "text"]


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def from_table(
    table: DataFrame, document: str | Column, text: str | Column, corpus: str | Column
) -> DataFrame:
    """Corpus from any table: name its document, text and corpus columns.

    Use ``F.lit("name")`` as ``corpus`` if the table is one corpus.
    """
    return table.select(
        _column(corpus).cast("string").alias("corpus"),
        _column(document).cast("string").alias("document"),
        _column(text).cast("string").alias("text"),
    )


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """Several corpora as one table; each keeps its own statistics because all counts are per corpus."""
    return reduce(DataFrame.unionByName, [c.select(*CORPUS_COLUMNS) for c in corpora])
