"""Joining the counts and weighting each (document, word) pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweight.functions.weights import icf_weight, score_weight, tf_weight
from lexiweight.operators.lookup import MOST_SALTS, join_spread, key_table, spread, spread_join

PAIR = ["corpus", "document", "word"]


def tf_parts(counts: DataFrame, pieces: int | None = None) -> DataFrame:
    """``(corpus, document, word, word_count, doc_size)`` from word counts of any corpus.

    Counts of combined tokens, which have a ``salt``, stay where they are.

    Here and below, ``pieces`` is the number of salts that the rows of a key are dealt out over, up to the
    bound of ``lookup.spread``.
    """
    dealt = counts if "salt" in counts.columns else spread(counts, ["corpus", "document"], pieces)
    return join_spread(dealt, size_table(dealt), ["corpus", "document"]).select(*PAIR, "word_count", "doc_size")


def size_table(dealt: DataFrame) -> DataFrame:
    """``(corpus, document, salt, doc_size)`` of word counts that are spread by document."""
    return key_table(dealt, ["corpus", "document"], F.col("word_count"), "doc_size")


def word_table(frequency: DataFrame, sizes: DataFrame, pieces: int | None = None) -> DataFrame:
    """``(corpus, word, num_docs, num_docs_with_word)``: one row per word of a corpus.

    The number of documents meets the vocabulary here, not the far longer list of pairs. The
    vocabulary of a corpus is dealt out too.
    """
    joined = _sized(frequency, sizes, pieces)
    return joined.select("corpus", "word", "num_docs", "num_docs_with_word")


def _sized(words: DataFrame, sizes: DataFrame, pieces: int | None) -> DataFrame:
    """Rows of words with the size of their corpus. Corpora are few, so more salts cost nothing."""
    most = 4 * int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread_join(words, sizes, ["corpus"], pieces or most, most)


def frequency_table(dealt: DataFrame, sizes: DataFrame, pieces: int | None = None) -> DataFrame:
    """``(corpus, word, salt, num_docs_with_word, num_docs)`` of pairs that are spread by word.

    A word meets the size of its corpus in one row, which holds its salts, ``MOST_SALTS`` at most, as bits.
    """
    places = dealt.groupBy("corpus", "word", "salt").agg(F.count(F.lit(1)).alias("part"))
    salts = F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("salt"))).alias("salts")
    words = places.groupBy("corpus", "word").agg(F.sum("part").alias("num_docs_with_word"), salts)
    own = F.filter(F.sequence(F.lit(0), F.lit(MOST_SALTS - 1)), lambda i: F.bit_get("salts", i) == 1)
    sized = _sized(words, sizes, pieces)
    return sized.select("corpus", "word", F.explode(own).alias("salt"), "num_docs_with_word", "num_docs")


def icf_parts(
    counts: DataFrame, frequency: DataFrame | None, sizes: DataFrame, pieces: int | None = None
) -> DataFrame:
    """``counts`` with ``num_docs`` and ``num_docs_with_word`` added to every row.

    ``counts`` holds a word once per document. Without ``frequency``, that of ``counts`` is found where
    its rows meet the table of words anyway; counts of combined tokens by word, which have a ``salt``, are
    there already.
    """
    if frequency is not None:
        return spread_join(counts, word_table(frequency, sizes, pieces), ["corpus", "word"], pieces)
    dealt = counts if "salt" in counts.columns else spread(counts, ["corpus", "word"], pieces, by=["document"])
    return join_spread(dealt, frequency_table(dealt, sizes, pieces), ["corpus", "word"])


def scores(parts: DataFrame) -> DataFrame:
    """``(corpus, document, word, tf, icf, score)`` from rows that carry all four counts."""
    weighted = parts.select(
        *PAIR,
        tf_weight(F.col("word_count"), F.col("doc_size")).alias("tf"),
        icf_weight(F.col("num_docs"), F.col("num_docs_with_word")).alias("icf"),
    )
    return weighted.withColumn("score", score_weight(F.col("tf"), F.col("icf")))


def scores_by_union(tf: DataFrame, icf: DataFrame) -> DataFrame:
    """``(corpus, document, word, score)`` by stacking both weights and multiplying per pair.

    An inner join of ``tf_parts`` and ``icf_parts`` written as union and product; it gives the
    score of ``scores`` and exists to be compared with it.
    """
    # Both sides are dealt as ``icf_parts`` deals its rows, so that its shuffle serves for one of them and
    # nothing is added up before the shuffle, where every pair would be held.
    tf, icf = (spread(side, ["corpus", "word"], by=["document"]) for side in (tf, icf))
    stacked = tf.select(
        *PAIR, "salt", tf_weight(F.col("word_count"), F.col("doc_size")).alias("weight")
    ).unionByName(
        icf.select(
            *PAIR, "salt", icf_weight(F.col("num_docs"), F.col("num_docs_with_word")).alias("weight")
        )
    )
    return stacked.groupBy(*PAIR, "salt").agg(F.product("weight").alias("score")).drop("salt")
