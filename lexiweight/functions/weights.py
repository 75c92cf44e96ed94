"""The weighting formula and the two text forms of a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tf_weight(word_count: Column, doc_size: Column) -> Column:
    """ln(word_count / doc_size + 1). Not ``log1p``: it differs in the last bits."""
    return F.log(word_count.cast("double") / doc_size.cast("double") + F.lit(1.0))


def icf_weight(num_docs: Column, num_docs_with_word: Column) -> Column:
    """ln((num_docs + 1) / (num_docs_with_word + 1)); 0 for a word of every document."""
    return F.log((num_docs + F.lit(1.0)) / (num_docs_with_word + F.lit(1.0)))


def score_weight(tf: Column, icf: Column) -> Column:
    return tf * icf


def format_score(score: Column, style: str = "shortest") -> Column:
    """``shortest``: fewest digits that read back as the same double; ``fixed``: 16 decimals."""
    if style == "shortest":
        return score.cast("string")
    if style == "fixed":
        return F.format_string("%.16f", score)
    raise ValueError(f"unknown style {style!r}, expected 'shortest' or 'fixed'")
