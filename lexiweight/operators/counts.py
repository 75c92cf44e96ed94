"""Counting: words per document, document sizes, vocabulary, documents per word and per corpus.

Every function is a ``groupBy`` with a declarable aggregate, so Spark combines on the map side
before it shuffles and a frequent word or a long document reaches the reducers as at most one row
per map task. ``word_count`` of combined tokens adds up after the shuffle instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiweight.operators.lookup import spread
from lexiweight.operators.tokens import keyed, single_row


def token_count(tokens: DataFrame) -> DataFrame:
    """``(corpus, document, num_tokens)``."""
    return tokens.groupBy("corpus", "document").agg(F.count(F.lit(1)).alias("num_tokens"))


def counted(tokens: DataFrame, *keys: str) -> DataFrame:
    """Occurrences per ``keys`` as ``word_count``.

    The filter lets every row pass. It makes each user of this table ask for the count, whether
    it goes on with it or not, so that all of them read one and the same shuffle; else those that
    need only the keys would split all texts a second time to get a shuffle without counts.
    """
    counts = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("word_count"))
    return counts.filter(F.col("word_count") > 0)


def word_count(tokens: DataFrame, pieces: int | None = None, key: str = "document") -> DataFrame:
    """``(corpus, document, word, word_count)``.

    Combined tokens are dealt out over salts by word, so that a document of any length is counted by
    many tasks, and added up where they come to lie: no map task holds its pairs. Their counts keep the
    column ``salt``, with which ``tf_parts`` finds the sizes of documents without another shuffle of them.
    With ``word`` as ``key`` they are dealt out by word, over salts by document, and ``icf_parts`` finds the
    frequencies of words in this way. ``pieces`` is the number of salts.
    """
    if "occurrences" in tokens.columns:
        dealt = spread(tokens, ["corpus", key], pieces, by=["document" if key == "word" else "word"])
        return dealt.groupBy("corpus", "document", "salt", "word").agg(F.sum("occurrences").alias("word_count"))
    return counted(tokens, "corpus", "document", "word")


def sized_word_count(sized_tokens: DataFrame) -> DataFrame:
    """``(corpus, document, word, word_count, doc_size)`` for corpora with one row per document."""
    counts = counted(sized_tokens, "corpus", "document", "doc_size", "word")
    return counts.select("corpus", "document", "word", "word_count", "doc_size")


def document_size(counts: DataFrame) -> DataFrame:
    """``(corpus, document, doc_size)``: occurrences of all words of the document."""
    return counts.groupBy("corpus", "document").agg(F.sum("word_count").alias("doc_size"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``(corpus, word)``, each once."""
    return tokens.select("corpus", "word").distinct()


def document_frequency(counts: DataFrame) -> DataFrame:
    """``(corpus, word, num_docs_with_word)``; ``counts`` holds a word once per document."""
    return counts.groupBy("corpus", "word").agg(F.count(F.lit(1)).alias("num_docs_with_word"))


def corpus_size(corpus: DataFrame, one_row_per_document: bool = False) -> DataFrame:
    """``(corpus, num_docs)``; documents without a single word count too.

    Two plain aggregations in place of ``count(distinct)``: the first spreads a big corpus over
    all tasks by document, the second sees one partial row per task and corpus. With
    ``one_row_per_document``, a document of several rows fails the query.
    """
    documents = keyed(corpus).groupBy("corpus", "document").agg(F.count(F.lit(1)).alias("num_rows"))
    if one_row_per_document:
        documents = documents.filter(single_row(F.col("num_rows")))
    return documents.groupBy("corpus").agg(F.count(F.lit(1)).alias("num_docs"))


def rekey(counts: DataFrame, key: str) -> DataFrame:
    """``(corpus, <key>, num_pairs, num_tokens)``: word counts regrouped by ``document`` or ``word``."""
    return counts.groupBy("corpus", key).agg(
        F.count(F.lit(1)).alias("num_pairs"), F.sum("word_count").alias("num_tokens")
    )
