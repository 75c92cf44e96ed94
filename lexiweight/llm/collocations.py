"""Collocations: phrases whose words occur together more often than their parts would (stripes)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiweight.llm import words as W
from lexiweight.llm.shared import saved, ship
from lexiweight.operators import spread_join

# Words of a phrase at most, occurrences at least, and phrases of a language that are reported.
MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
# The language of rows that name none.
NO_LANGUAGE = "und"
# Texts whose stripes are merged in a task before they are passed on, in bytes.
PORTION_BYTES = 8 << 20
# Pairs of words that a task counts by hash before it passes them on, and that a bucket holds.
PORTION = 1 << 22
# Bits of the filter of frequent phrases that goes to the tasks: from 64 Kbit up, 2 MB at most.
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 16, 1 << 24

# These separate words, and those end a piece of text too.
_BLANKS, _ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_SEPARATOR, _END = np.zeros(256, bool), np.zeros(256, bool)
_SEPARATOR[list(_BLANKS + _ENDS)] = True
_END[list(_ENDS)] = True
_BLANK_ONLY = np.zeros(256, bool)
_BLANK_ONLY[0x20] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 0x20

_STRIPES = "lang string, prefixes array<string>, words array<string>, counts array<bigint>"
_HASHED = "bucket int, keys binary, counts binary"


def _language_hashes(names: pa.Array) -> np.ndarray:
    block = next(W.blocks(names, limit=1 << 40, rows=1 << 30))
    whole = W.Words(block.offsets[:-1], block.offsets[1:], np.arange(len(names)), np.zeros(len(names)), np.ones(len(names)))
    full = np.flatnonzero(whole.end > whole.start)
    hashes = np.zeros(len(names), np.uint64)
    hashes[full] = W.word_hashes(block, W.Words(*(x[full] for x in (whole.start, whole.end, whole.doc, whole.at, whole.count))), seed=9)
    return hashes


def _phrase_hashes(hashes: np.ndarray, size: int, language: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` words from every place on, in their language."""
    own = W.window_hashes(hashes, size)
    with np.errstate(over="ignore"):
        return W.mix(own ^ language[: len(own)] * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Filter:
    """Two bits for each phrase of a set, found by the leading bits of its hash: a phrase that lacks one
    of them is not in the set."""

    table: np.ndarray
    shift: int

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        one, two = _bits_of(hashes, self.shift, 8 * len(self.table))
        return ((self.table[one >> 3] >> (one & 7)) & (self.table[two >> 3] >> (two & 7)) & 1).astype(bool)


def _bits_of(hashes: np.ndarray, shift: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    code = W.mix(hashes >> np.uint64(shift))
    mask = np.uint64(bits - 1)
    return (code & mask).astype(np.int64), ((code >> np.uint64(32)) & mask).astype(np.int64)


def _set_bits(hashes: np.ndarray, shift: int, bits: int) -> pa.RecordBatch:
    place = np.unique(np.concatenate(_bits_of(hashes, shift, bits)))
    return pa.RecordBatch.from_arrays([pa.array(place >> 3), pa.array((1 << (place & 7)).astype(np.int32))], names=["byte", "bit"])


def _gathered(bytes_and_bits: DataFrame, shift: int, bits: int) -> Filter:
    """A filter from the bits that tasks set, combined by Spark: the driver gets a row for each byte of
    the filter at most."""
    rows = bytes_and_bits.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy()
    return Filter(table, shift)


def _filter(frequent: DataFrame, size: int) -> Filter:
    """The filter of the phrases of ``size`` words of a table ``(lang, phrase)``."""
    wanted = 1 << (16 * max(1, frequent.count()) - 1).bit_length()
    bits = min(max(wanted, MIN_FILTER_BITS), MAX_FILTER_BITS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            language = _language_hashes(batch.column("lang"))
            for block in W.blocks(batch.column("phrase")):
                found = W.split(block, _BLANK_ONLY)
                at = W.whole_windows(found, size)
                own = language[block.rows.start + found.doc]
                yield _set_bits(_phrase_hashes(W.word_hashes(block, found), size, own)[at], 0, bits)

    return _gathered(frequent.select("lang", "phrase").mapInArrow(find, "byte bigint, bit int"), 0, bits)


@dataclass
class Text:
    """The words of a block, lower-cased: hashes, the language of each, and the piece it is in."""

    block: W.Block
    found: W.Words
    hashes: np.ndarray
    language: np.ndarray
    own: np.ndarray
    piece: np.ndarray

    def phrases(self, size: int, known: Filter | None = None, words: int = 0) -> np.ndarray:
        """Where phrases of ``size`` words start, whose first and last ``words`` are in the filter."""
        n = max(0, len(self.hashes) - size + 1)
        doc, piece = self.found.doc, self.piece
        at = np.flatnonzero((doc[:n] == doc[size - 1 :]) & (piece[:n] == piece[size - 1 :])) if n else np.zeros(0, np.int64)
        if known is not None and len(at):
            frequent = known.may_hold(_phrase_hashes(self.hashes, words, self.language[self.own]))
            at = at[frequent[at] & frequent[at + size - words]]
        return at


def _texts(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[Text, pa.Array]]:
    """The texts of a batch in blocks, and the names of the languages."""
    coded = batch.column("lang").dictionary_encode()
    code, language = coded.indices.to_numpy(), _language_hashes(coded.dictionary)
    for block in W.blocks(batch.column("text"), limit):
        lower = W.Block(block.rows, _LOWER[block.data], block.offsets)
        found = W.split(lower, _SEPARATOR)
        own = code[block.rows.start : block.rows.stop][found.doc]
        yield Text(lower, found, W.word_hashes(lower, found), language, own, np.cumsum(_END[lower.data])[found.start]), coded.dictionary


def _likely_pairs(docs: DataFrame, known: Filter, least: int) -> Filter:
    """The filter of all pairs of words that occur ``least`` times, and of few others: those that share
    32 bits and the bucket of their hash with such pairs.

    Nearly all pairs are rare; they travel as four bytes and a count instead of words. A count is passed
    on up to ``least``, which decides as well as the whole.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, (size // 6 // PORTION).bit_length())
    model = docs.sparkSession.sparkContext.broadcast(known)
    kind = np.uint8 if least < 256 else np.uint32

    def emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        counts = np.minimum(counts, least).astype(kind)
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 40))
        low = keys.astype(np.uint32)
        spans = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[edges[:-1]], pa.int32()),
                pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            names=["bucket", "keys", "counts"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text, _ in _texts(batch, PORTION_BYTES):
                at = text.phrases(2, model.value, 1)
                if len(at):
                    hashes = _phrase_hashes(text.hashes, 2, text.language[text.own])[at]
                    parts.append(np.unique(hashes >> np.uint64(32 - bits), return_counts=True))
                    held += len(parts[-1][0])
                if held >= PORTION:
                    yield from emit(parts)
                    parts, held = [], 0
        if parts:
            yield from emit(parts)

    def add(table: pa.Table) -> pa.Table:
        bucket = np.uint64(table.column("bucket")[0].as_py())
        keys = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]
        counts = [np.frombuffer(x.as_py(), kind) for x in table.column("counts")]
        key, total = _summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        frequent = key[total >= least].astype(np.uint64) | (bucket << np.uint64(32))
        # As leading bits of a hash, from which the filter takes its bits.
        return pa.Table.from_batches([_set_bits(frequent << np.uint64(32 - bits), 32 - bits, MAX_FILTER_BITS)])

    found = docs.mapInArrow(count, _HASHED).groupBy("bucket").applyInArrow(add, "byte bigint, bit int")
    return _gathered(found, 32 - bits, MAX_FILTER_BITS)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def _stripes(docs: DataFrame, sizes: list[int], known: Filter | None = None, words: int = 0) -> DataFrame:
    """Stripes of phrases of each of ``sizes`` words: for the first words of a phrase, an associative
    counter of the words that follow. A row ``(lang, prefixes, words, counts)`` has all entries of a
    portion of texts.

    ``known`` is a filter of the frequent phrases of ``words`` words. A phrase whose first or last ones
    are not in it cannot be frequent and is not counted.
    """
    model = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, names in _texts(batch, PORTION_BYTES):
                for size in sizes:
                    at = text.phrases(size, model.value, words)
                    if len(at):
                        yield portion(text, names, size, at)

    def portion(text: Text, names: pa.Array, size: int, at: np.ndarray) -> pa.RecordBatch:
        block, found = text.block, text.found
        # Numbers of the different words of a language, and of the prefixes made up of them.
        used, word = np.unique((at[:, None] + np.arange(size)).ravel(), return_inverse=True)
        with np.errstate(over="ignore"):
            keys = text.hashes[used] ^ W.mix((text.own[used] + 1).astype(np.uint64))
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        word = number[word].reshape(-1, size)
        distinct = len(first)
        prefix = text.own[at].astype(np.int64)
        for i in range(size - 1):
            prefix = np.unique(prefix * distinct + word[:, i], return_inverse=True)[1]
        _, example, counts = np.unique(prefix * distinct + word[:, -1], return_index=True, return_counts=True)
        raw = block.data.tobytes()
        spelled = [raw[a:b] for a, b in zip(found.start[used[first]].tolist(), found.end[used[first]].tolist(), strict=True)]
        spelled = pa.array(spelled, pa.binary()).cast(pa.string())
        # The entries of one language after the other.
        own = text.own[at[example]]
        order = np.argsort(own, kind="stable")
        own, example, counts = own[order], example[order], counts[order]
        edges = np.flatnonzero(np.diff(own, prepend=-1, append=1 << 30))
        offsets = pa.array(edges.astype(np.int32))
        prefixes = [spelled.take(pa.array(word[example, i])) for i in range(size - 1)]
        return pa.RecordBatch.from_arrays(
            [
                names.take(pa.array(own[edges[:-1]])),
                pa.ListArray.from_arrays(offsets, pc.binary_join_element_wise(*prefixes, " ") if prefixes else pa.array([""] * len(own))),
                pa.ListArray.from_arrays(offsets, spelled.take(pa.array(word[example, -1]))),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
            ],
            names=["lang", "prefixes", "words", "counts"],
        )

    return docs.mapInArrow(count, _STRIPES)


def _merged(stripes: DataFrame) -> DataFrame:
    """``(lang, prefix, word, count)``: stripes of a prefix added up word by word. A stripe stays spread
    over rows, so no task holds all that follows a frequent prefix."""
    columns = (F.col("prefixes").alias("prefix"), F.col("words").alias("word"), F.col("counts").alias("part"))
    entries = stripes.select("lang", F.inline(F.arrays_zip(*columns)))
    return entries.groupBy("lang", "prefix", "word").agg(F.sum("part").alias("count"))


def _phrase() -> Column:
    return F.when(F.col("prefix") == "", F.col("word")).otherwise(F.concat_ws(" ", "prefix", "word")).alias("phrase")


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(lang, size, prefix, word, phrase, count)`` of all phrases of up to ``longest`` words that occur
    ``least`` times, and ``(lang, n)``, the number of words of each language.

    Words are counted first. Pairs of frequent words are then counted by hash; the frequent ones are a
    filter for the stripes of phrases of two and three words, and the merged stripes of the
    frequent phrases of each length become a filter for the next one. The filters have a bounded number
    of bits; they only save work, as what is counted in stripes is exact. Both tables lie in the
    shared folder.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.col("text").isNotNull())

    def frequent(counted: DataFrame, size: Column, name: str) -> DataFrame:
        often = counted.filter(F.col("count") >= least).select("lang", size.alias("size"), "prefix", "word", _phrase(), "count")
        return saved(often, name)

    words = saved(_merged(_stripes(texts, [1])), "words")
    sizes = saved(words.groupBy("lang").agg(F.sum("count").alias("n")), "languages")
    tables = [frequent(words, F.lit(1), "phrases-1")]
    if longest > 1:
        pairs = _likely_pairs(texts, _filter(tables[0], 1), least)
        both = _merged(_stripes(texts, [2, 3][: longest - 1], pairs, 2))
        tables.append(frequent(both, F.size(F.split("prefix", " ")) + 1, "phrases-2-3"))
    for size in range(4, longest + 1):
        known = _filter(tables[-1].filter(F.col("size") == size - 1), size - 1)
        tables.append(frequent(_merged(_stripes(texts, [size], known, size - 1)), F.lit(size), f"phrases-{size}"))
    return reduce(DataFrame.unionByName, tables), sizes


def _parts(phrase: Column, cut: Column) -> tuple[Column, Column]:
    words = F.split(phrase, " ")
    rest = F.slice(words, cut + 1, F.size(words) - cut)
    return F.array_join(F.slice(words, F.lit(1), cut), " "), F.array_join(rest, " ")


def _looked_up(rows: DataFrame, table: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part`` as ``name``."""
    counts = table.select("lang", F.col("phrase").alias(part), F.col("count").alias(name))
    return spread_join(rows, counts, ["lang", part])


def collocations(
    docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, percent: int = 100
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends, and those at blanks
    and tabs into words. Phrases are 2 to ``longest`` consecutive words of a piece with ``a``, at least
    ``least``, occurrences in the language. Cut in two, with ``l`` and ``r`` occurrences of the
    parts and ``n`` words in the language, a phrase scores floor(1000 * a * n / (l * r)); its lowest
    cut counts, the first of equal ones. A phrase goes if a longer one of at least ``percent`` % of its
    occurrences holds it. The rest are ranked by score, ``a`` (both descending) and phrase (bytes).

    Everything comes from stripes, a counter of next words for each prefix: the counts of phrases and
    parts are entries, and as an extension by one word has the most occurrences of all longer
    phrases, the entries of a stripe (and, seen from the words but the first, of the stripes
    with one more word before) have the maxima that decide what goes.

    A null ``lang`` is ``und``; null and empty texts have no words; repeated rows count each. An
    empty table has no phrases, and other columns are ignored.
    """
    phrases, sizes = frequent_phrases(docs, least, longest)
    longer = phrases.filter("size > 1")
    tail = F.concat_ws(" ", F.when(F.col("size") > 2, F.call_function("substring_index", "prefix", F.lit(" "), 2 - F.col("size"))), "word")
    held = longer.select("lang", F.explode(F.array("prefix", tail)).alias("phrase"), "count")
    held = held.groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    candidates = longer.join(held, ["lang", "phrase"], "left").filter(
        F.coalesce(F.lit(100) * F.col("longer") < F.lit(percent) * F.col("count"), F.lit(True))
    )
    candidates = saved(candidates, "candidates")
    cuts = candidates.select("lang", "phrase", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    first, rest = _parts(F.col("phrase"), F.col("k"))
    cuts = cuts.withColumns({"first": first, "rest": rest})
    cuts = _looked_up(_looked_up(cuts, phrases, "first", "l"), phrases, "rest", "r")
    cuts = spread_join(cuts, sizes, ["lang"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    thousand = (wide["a"] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)")
    score = F.call_function("div", thousand * wide["n"], wide["l"] * wide["r"])
    lowest = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    lowest = lowest.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")

    def ranked(rows: DataFrame, *groups: str) -> DataFrame:
        order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.desc("a"), "phrase")
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    # The best of each of many parts of a language first, so that no task sorts all its phrases.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = ranked(scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))), "lang", "part")
    best = ranked(best.drop("rank"), "lang")
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
