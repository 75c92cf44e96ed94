"""From documents to one row per word occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiweight.functions.text import words

# Slots of documents at most that ``by_rows`` sends to every task.
SLOTS = 1 << 17


def keyed(corpus: DataFrame) -> DataFrame:
    """The same rows; one without a corpus or a document fails the query.

    The last value tells Spark that the names are never null. Joins then need not add null
    filters of their own to some branches of a plan but not to others, which would stop Spark from
    sharing a shuffle.
    """
    names = {
        c: F.coalesce(c, F.raise_error(F.lit(f"a row of the corpus has no {c}")).cast("string"), F.lit(""))
        for c in ("corpus", "document")
    }
    return corpus.withColumns(names)


def single_row(num_rows: Column) -> Column:
    """True for a document of one row; any other fails the query."""
    return F.when(num_rows == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("a document has several rows: do not pass one_row_per_document"))
    )


def whole_documents(corpus: DataFrame) -> DataFrame:
    """The same corpus, with the promise that each row is a whole document checked as it runs.

    The check reads the two key columns only.
    """
    rows = keyed(corpus).groupBy("corpus", "document").agg(F.count(F.lit(1)).alias("num_rows"))
    checked = rows.agg(F.count_if(single_row(F.col("num_rows"))).alias("checked"))
    return corpus.filter(checked.scalar() >= 0)


def slot_of(corpus: DataFrame) -> Column:
    """One of ``SLOTS`` numbers for the document of a row, by a hash."""
    return F.pmod(F.xxhash64("corpus", "document"), F.lit(SLOTS))


def slots_of_many_rows(corpus: DataFrame) -> DataFrame:
    """``(slot)`` of the documents that have several rows, each once: ``SLOTS`` rows at most.

    Only the two key columns are read.
    """
    named = keyed(corpus)
    rows = named.groupBy("corpus", "document").agg(F.count(F.lit(1)).alias("num_rows"))
    several = rows.filter("num_rows > 1")
    return several.select(slot_of(several).alias("slot")).distinct()


def by_rows(corpus: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents of one row that are known as such by ``slots_of_many_rows``, and all others.

    The slots are sent to every task: their number is bounded, whatever the documents. Those of one row
    that share a slot with one of several are among the others.
    """
    named = keyed(corpus)
    placed = named.withColumn("slot", slot_of(named))
    whole, others = (placed.join(F.broadcast(slots), "slot", how) for how in ("left_anti", "left_semi"))
    return whole.drop("slot"), others.drop("slot")


def _one_row_per_word(rows: DataFrame, words_column: Column, *keep: str) -> DataFrame:
    """Explode, without the filter on the array size that Spark adds below a plain ``explode``:
    that filter is pushed down to the text and would split every text twice."""
    exploded = rows.select(*keep, F.explode_outer(words_column).alias("word"))
    return exploded.filter(F.col("word").isNotNull())


def tokens(corpus: DataFrame, profile: str = "raw", combined: bool = False) -> DataFrame:
    """``(corpus, document, word)``, one row per occurrence.

    A document may span any number of rows of ``corpus`` (lines, turns, pages). ``combined`` adds up the
    occurrences within each of these rows: ``(corpus, document, word, occurrences)``.
    """
    if combined:
        counts = row_counts(corpus, profile)
        return counts.select("corpus", "document", "word", F.col("word_count").alias("occurrences"))
    return _one_row_per_word(
        keyed(corpus), words(F.col("text"), profile), "corpus", "document"
    )


def sized_tokens(corpus: DataFrame, profile: str = "raw") -> DataFrame:
    """``(corpus, document, doc_size, word)`` for corpora with one row per document.

    The size is known as soon as the row is split, so carrying it along saves the shuffle and
    the join that would otherwise find it out.
    """
    split = keyed(corpus).select("corpus", "document", words(F.col("text"), profile).alias("words"))
    sized = split.withColumn("doc_size", F.size("words").cast("bigint"))
    return _one_row_per_word(sized, F.col("words"), "corpus", "document", "doc_size")


def row_counts(corpus: DataFrame, profile: str = "raw") -> DataFrame:
    """``(corpus, document, word, word_count, doc_size)`` for corpora with one row per document.

    The words of a row are sorted and their runs measured within the row, so nothing is shuffled.
    Every step is a column of its own, lest it be worked out again for each word.
    """
    split = keyed(corpus).select("corpus", "document", F.sort_array(words(F.col("text"), profile)).alias("words"))
    number = F.size("words")
    new = F.when(
        number > 0,
        F.filter(F.sequence(F.lit(0), number - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))),
    )
    starts = split.withColumns({"doc_size": number.cast("bigint"), "starts": new})
    runs = F.when(
        number > 0,
        F.transform(
            F.sequence(F.lit(0), F.size("starts") - 1),
            lambda j: F.struct(
                F.get("words", F.get("starts", j)).alias("word"),
                (F.coalesce(F.get("starts", j + 1).cast("bigint"), F.col("doc_size")) - F.get("starts", j)).alias("word_count"),
            ),
        ),
    )
    pairs = starts.select("corpus", "document", F.explode_outer(runs).alias("pair"), "doc_size")
    counted = pairs.select("corpus", "document", "pair.word", "pair.word_count", "doc_size")
    return counted.filter(F.col("word").isNotNull())
