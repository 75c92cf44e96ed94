"""The whole analytic, from corpora to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexiweight import operators as op
from lexiweight.sinks import write_stage
from lexiweight.sources.stages import scan_stage
from lexiweight.storage import read_buckets, write_buckets

BY_DOCUMENT, BY_WORD = ["corpus", "document", "salt"], ["corpus", "word", "salt"]


def term_counts(
    corpus: DataFrame,
    profile: str = "raw",
    one_row_per_document: bool = False,
    pieces: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``tf_parts`` and ``document_frequency`` of a corpus, over one shared shuffle of the words.

    ``one_row_per_document`` saves a shuffle and a join of all pairs. The promise is not checked
    here: pass ``operators.whole_documents(corpus)`` to have it checked.
    """
    if one_row_per_document:
        parts = op.row_counts(corpus, profile)
        return parts, op.document_frequency(parts)
    # The salt of a document is a part of its words. The rows stay where they were counted.
    counts = counts_by_document(corpus, profile, pieces)
    sizes = op.size_table(counts).withColumnRenamed("salt", "salt_of_word")
    dealt = counts.withColumnRenamed("salt", "salt_of_word")
    parts = dealt.join(sizes.hint("shuffle_hash"), ["corpus", "document", "salt_of_word"])
    return parts.select("corpus", "document", "word", "word_count", "doc_size"), op.document_frequency(counts)


def term_weights(
    corpus: DataFrame,
    profile: str = "raw",
    one_row_per_document: bool = False,
    sizes: DataFrame | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """``(corpus, document, word, tf, icf, score)``, a row per distinct word of each document.

    With ``one_row_per_document``, a document of several rows fails the query. ``sizes`` is
    ``(corpus, num_docs)`` for sources that yield no row for an empty document; by default the
    documents of ``corpus`` are counted. ``pieces`` is the number of salts that the rows of a word, or
    of a document, are dealt out over (see ``operators.spread``); the plan is the same for any data.
    """
    if sizes is None:
        sizes = op.corpus_size(corpus, one_row_per_document)
    elif one_row_per_document:
        corpus = op.whole_documents(corpus)
    parts, _ = term_counts(corpus, profile, one_row_per_document, pieces)
    return op.scores(op.icf_parts(parts, None, sizes, pieces))


def counts_by_document(corpus: DataFrame, profile: str = "raw", pieces: int | None = None) -> DataFrame:
    """``(corpus, document, salt, word, word_count)``, shuffled by its first three columns.

    Each row of the corpus is counted by itself first; the words of a document are dealt out over salts
    by word, so that a document of any length is counted by many tasks.
    """
    return op.word_count(op.tokens(corpus, profile, combined=True), pieces)


def parts_of_counts(counts: DataFrame) -> DataFrame:
    """``(corpus, document, word, word_count, doc_size)`` from a stage of ``counts_by_document``, whose rows
    stay where they lie."""
    return op.join_spread(counts, op.size_table(counts), ["corpus", "document"])


def scores_of_parts(parts: DataFrame, sizes: DataFrame, pieces: int | None = None) -> DataFrame:
    """``(corpus, document, word, score)`` from parts in buckets by word, whose rows stay where they lie."""
    table = op.frequency_table(parts, sizes, pieces)
    return op.scores(op.join_spread(parts, table, ["corpus", "word"])).select("corpus", "document", "word", "score")


def term_weights_staged(
    corpus: DataFrame,
    path: str,
    profile: str = "raw",
    sizes: DataFrame | None = None,
    form: str = "parquet",
    pieces: int | None = None,
) -> DataFrame:
    """``(corpus, document, word, score)``, each stage written below ``path`` and the next one
    started from the written copy.

    ``form`` is ``parquet``, or ``text`` for the tab-separated lines of ``sinks.write_stage``.
    ``path`` must be on storage that all workers share.

    The Parquet stage ``word_count`` has two parts. Documents of one row are written where they are counted,
    with their size; those of several are shuffled into buckets by document, where their sizes come to them.
    The stage ``tf_parts`` is in buckets by word. So the pairs of most documents are shuffled once, into that
    layout, and those of several rows twice: what a stage joins with them comes to where they lie. Names of
    corpora, documents and words are columns of any content. ``pieces`` is the number of salts of
    ``operators.spread``.
    """
    spark = corpus.sparkSession
    sizes = op.corpus_size(corpus) if sizes is None else sizes
    if form == "text":

        def stage(table: DataFrame, name: str) -> DataFrame:
            write_stage(table, name, f"{path}/{name}")
            return scan_stage(spark, f"{path}/{name}", name)

        parts = stage(op.tf_parts(stage(op.word_count(op.tokens(corpus, profile)), "word_count")), "tf_parts")
        weighted = op.scores(op.icf_parts(parts, None, sizes, pieces))
        return stage(weighted.select("corpus", "document", "word", "score"), "scores")

    def written(table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(table.schema).parquet(f"{path}/{name}")

    def bucketed(table: DataFrame, name: str, keys: list[str]) -> DataFrame:
        write_buckets(table, f"{path}/{name}", keys)
        return read_buckets(spark, f"{path}/{name}", table.schema, keys)

    whole, others = op.by_rows(corpus, written(op.slots_of_many_rows(corpus), "slots"))
    sized = written(op.row_counts(whole, profile), "word_count/whole")
    counts = bucketed(counts_by_document(others, profile, pieces), "word_count/others", BY_DOCUMENT)
    all_parts = sized.unionByName(parts_of_counts(counts))
    by_word = op.spread(all_parts, ["corpus", "word"], pieces, by=["document"])
    parts = bucketed(by_word, "tf_parts", BY_WORD)
    return written(scores_of_parts(parts, sizes, pieces), "scores")
