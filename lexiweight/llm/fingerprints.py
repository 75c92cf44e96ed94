"""Fingerprints of documents: bottom-k sketches of the hashes of their shingles, in Spark SQL alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweight.llm.shared import saved

# Words of a shingle, hashes of a sketch, and hexadecimal digits of a hash (64 bits).
SHINGLE, SKETCH, DIGITS = 5, 128, 16
# Digits that a double holds whole.
_EXACT = 13
_SEPARATORS = r"[ \t\n\x0B\f\r]+"


def shingle_hashes(words: Column, shingle: int = SHINGLE) -> Column:
    """Hashes, as text, of every ``shingle`` consecutive words; fewer words are one shingle, none
    are none. ``words`` must be a column of its own, lest it be worked out once for each shingle."""
    last = F.greatest(F.size(words) - F.lit(shingle), F.lit(0))
    all_of = F.transform(
        F.sequence(F.lit(1), last + 1),
        lambda i: F.left(F.md5(F.array_join(F.slice(words, i, F.lit(shingle)), " ")), F.lit(DIGITS)),
    )
    return F.when(F.size(words) > 0, all_of).otherwise(F.array().cast("array<string>"))


def smallest(hashes: Column, k: int = SKETCH) -> Column:
    """The sketch of an array of hashes: its ``k`` smallest different ones, in order."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(one: Column, other: Column, k: int = SKETCH) -> Column:
    """The sketch of the union of two sets of shingles, from their sketches."""
    return smallest(F.concat(one, other), k)


def resemblance(one: Column, other: Column, union: Column) -> Column:
    """Estimated Jaccard similarity of two sets of shingles: the share of the sketch of their ``union``
    that both sketches hold. It is exact for sets that the sketches hold whole; two empty sets are alike."""
    both = F.size(F.array_intersect(union, F.array_intersect(one, other)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = SKETCH) -> Column:
    """Estimated number of different shingles, from the largest hash of a full sketch; exact below."""
    largest = F.conv(F.left(F.element_at(sketch, -1), F.lit(_EXACT)), 16, 10).cast("bigint")
    share = (largest + F.lit(1)) / F.lit(16.0**_EXACT)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(one: Column, other: Column, union: Column, k: int = SKETCH) -> Column:
    """Estimated share of the shingles of ``one`` that ``other`` has too (1 for none)."""
    common = resemblance(one, other, union) * distinct_shingles(union, k)
    own = distinct_shingles(one, k)
    return F.when(own == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / own))


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def from_text(fingerprint: Column) -> Column:
    """Undo ``as_text``."""
    return F.filter(F.split(fingerprint, f"(?<=\\G.{{{DIGITS}}})"), lambda h: h != "")


def with_sketch(table: DataFrame, text: str, name: str, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """``table`` with the sketch of the words of column ``text`` as ``name``. Words are the runs of
    characters other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), "")
    split = table.withColumn("words_of_text", words)
    return split.withColumn(name, smallest(shingle_hashes(F.col("words_of_text"), shingle), k)).drop("words_of_text")


def merged_sketches(parts: DataFrame, keys: list[str], sketch: str = "sketch", k: int = SKETCH) -> DataFrame:
    """``(*keys, sketch)``: the sketch of the union of all parts of a key, from their sketches.

    Every task passes on the ``k`` smallest hashes of a key only, so a key may have any number of parts.
    Keys may be null; parts that are null or empty add nothing, and a key of nothing else has an
    empty sketch.
    """
    hashes = parts.select(*keys, F.explode_outer(sketch).alias("hash")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("hash"))
    least = hashes.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def _num_ranges(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranges(docs: DataFrame) -> DataFrame:
    """``docs`` with ``range`` and ``tie``: the rows dealt out to as many ranges of ``doc_id`` as there are
    shuffle partitions. A ``doc_id`` of more rows than a range should have is several ranges itself, told
    apart by ``tie``. Rows of a higher range come later in the order of ``doc_id``, then ``tie``."""
    parts = _num_ranges(docs)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 52))
    rows = docs.withColumn("tie", place).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # Less numbers than there are ranges.
    shares = [i / parts for i in range(1, parts)]
    found = rows.agg(F.percentile_approx("key", shares, 20 * parts)).first()[0] if shares else None
    bounds = F.lit(found or []).cast("array<bigint>")
    below = F.size(F.filter(bounds, lambda b: b < F.col("key")))
    equal = F.size(F.filter(bounds, lambda b: b == F.col("key")))
    slice_of = F.floor(F.col("tie") / F.lit(float(1 << 52)) * (equal + 1)).cast("int")
    return rows.withColumn("range", below + slice_of)


def _edited(text: Column, following: Column) -> Column:
    """The last half of the characters replaced by as many of the text that follows, or all of it."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def _compared(rows: DataFrame, shingle: int, k: int, *more: Column) -> DataFrame:
    """The result, and ``more``, from ``text``, ``sketch`` and those of the next document."""
    rows = with_sketch(rows.withColumn("edited", _edited(F.col("text"), F.col("next_text"))), "edited", "edited_sketch", shingle, k)
    own, edited, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    unions = {"with_edited": merge(own, edited, k), "with_next": merge(own, following, k)}
    with_edited, with_next = F.col("with_edited"), F.col("with_next")
    rows = rows.withColumns(unions)
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(own).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"),
        resemblance(own, edited, with_edited).alias("near_edited"),
        resemblance(own, following, with_next).alias("near_next"),
        containment(own, edited, with_edited, k).alias("edited_holds"),
        distinct_shingles(own, k).alias("shingles"),
        *more,
    )


def compare_with_next(docs: DataFrame, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edited_holds, shingles)`` for every document.

    The fingerprint of a text is the sketch of its shingles of ``shingle`` words, as text. The next
    document is the one of the next smaller ``doc_id``; the smallest is followed by the largest.
    The edited text has its last half (of its code points, rounded down) replaced by as many from the
    start of the next document's, or all that it has. ``near_edited`` and ``near_next`` estimate the
    resemblance of a text with its edited text and with the next one, ``edited_holds`` the share of its
    shingles that the edited text has, ``shingles`` how many different ones it has.

    Texts travel once, to ranges of ``doc_id``; a task reads a range in order. The last document of a range
    is completed afterwards with the first of the next range that has any: a row for each range. Null
    ``doc_id`` come last. Rows that repeat a ``doc_id`` follow each other in an order given by
    their place in the table. A null text is an empty one, whose sketch is empty. A single document is
    followed by itself; an empty table gives none. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = _ranges(texts).select("doc_id", "text", "key", "tie", "range")
    dealt = dealt.repartitionById(_num_ranges(docs), "range")
    order = Window.partitionBy("range").orderBy(F.desc("key"), F.desc("tie"))
    ordered = with_sketch(dealt, "text", "sketch", shingle, k).select(
        "doc_id",
        "text",
        "sketch",
        "range",
        F.lead("text").over(order).alias("next_text"),
        F.lead("sketch").over(order).alias("next_sketch"),
        (F.row_number().over(order) == 1).alias("first"),
    )
    # The texts at both ends of a range are kept, to be joined over the border.
    last = F.col("next_text").isNull()
    end = [F.when(F.col("first") | last, F.col(c)).alias(c) for c in ("text", "sketch")]
    table = saved(_compared(ordered, shingle, k, "range", "first", last.alias("last"), *end), "fingerprints")
    firsts = table.filter("first").select(F.col("range").alias("from"), F.col("text").alias("next_text"), F.col("sketch").alias("next_sketch"))
    # As many rows as there are ranges; the one after the lowest is the highest.
    down = Window.orderBy(F.desc("range"))
    highest = F.first("range").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    links = table.filter("first").select("range", F.coalesce(F.lead("range").over(down), highest).alias("from"))
    ends = table.filter("last").select("doc_id", "text", "sketch", "range").join(links, "range").join(firsts, "from")
    whole = table.filter(~F.col("last")).drop("range", "first", "last", "text", "sketch")
    return whole.unionByName(_compared(ends, shingle, k))
