"""Periodic runs of words (online sparse diagonal dynamic programming)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweight.llm import words as W
from lexiweight.llm.shared import ship

# A run has at least so many words, and its period at least so many times.
MIN_LENGTH, MIN_POWER = 6, 4
# Words of candidate diagonals that are compared at once; a longer diagonal is compared alone.
PORTION = 1 << 21

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _repeated(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key occurs again, grouped by key and ascending, and the number of their group."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    group = np.cumsum(np.append(True, key[1:] != key[:-1])[: len(key)]) - 1
    again = np.bincount(group, minlength=1)[group] > 1
    return at[again], group[again]


def _occurrences(at: np.ndarray, group: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells (place, lag): earlier occurrences of the ``size`` words at a place, ``size`` to
    ``2 * size - 1`` words before it.

    Words that occur again within half their length have a period of half their length at most;
    they are left out (see ``find_runs``). Others lie more than half their length apart, so there
    are three earlier occurrences of interest at most, however often they occur."""
    if not len(at):
        return
    same = group[1:] == group[:-1]
    dense = np.zeros(group[-1] + 1, bool)
    dense[group[1:][same & (2 * (at[1:] - at[:-1]) <= size)]] = True
    sparse = ~dense[group]
    at, group = at[sparse], group[sparse]
    for back in range(1, len(at)):
        lag = at[back:] - at[:-back]
        near = (group[back:] == group[:-back]) & (lag < 2 * size)
        if not near.any():
            return
        cell = near & (lag >= size)
        yield at[back:][cell], lag[cell]


def _diagonals(place: np.ndarray, lag: np.ndarray, size: np.ndarray, doc: np.ndarray):
    """Stretches ``(first, last, lag)`` of words that are worth comparing with those a lag before.

    The cells of a lag are taken in the order of their places: as long as the next one is at most a
    lag away it adds to the match of its diagonal, else the diagonal ends."""
    order = np.lexsort((place, lag))
    place, lag, size = place[order], lag[order], size[order]
    goes_on = (lag[1:] == lag[:-1]) & (place[1:] - place[:-1] <= lag[1:]) & (doc[place[1:]] == doc[place[:-1]])
    first = np.flatnonzero(np.append(True, ~goes_on)[: len(place)])
    cells = np.diff(np.append(first, len(place)))
    first, cells = first[cells > 1], cells[cells > 1]
    last = first + cells - 1
    return place[first] - lag[first], place[last] + size[last] + lag[first], lag[first]


def _matches(keys: np.ndarray, first: np.ndarray, last: np.ndarray, lag: np.ndarray):
    """Maximal matches ``(first, length, lag)`` of words with those a lag before, in given stretches."""
    length = last - first
    edges = np.cumsum(length)
    a = 0
    while a < len(length):
        base = edges[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(edges, base + PORTION, "right")))
        own = length[a:b]
        place = np.repeat(first[a:b], own) + W.spans(own)
        back = np.repeat(lag[a:b], own)
        same = keys[place] == keys[place - back]
        # A match begins after a mismatch or with its stretch, and ends likewise.
        starts = np.append(0, np.cumsum(own)[:-1])
        begins, ends = same.copy(), same.copy()
        begins[1:] &= ~same[:-1]
        begins[starts] = same[starts]
        ends[:-1] &= ~same[1:]
        ends[starts[1:] - 1] = same[starts[1:] - 1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
        yield place[begin], end - begin + 1, back[begin]
        a = b


def find_runs(
    keys: np.ndarray, doc: np.ndarray, count: np.ndarray, least: int = MIN_LENGTH, power: int = MIN_POWER
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, length, period)`` of all runs, by start, then period.

    ``keys`` are numbers of the words of several texts one after the other, equal for equal words
    of a text and different otherwise; ``doc`` is the text of each word and ``count`` the number of
    words of each text.

    A run of period q is a diagonal of the matrix that compares the text with itself: its words
    equal those q before, for a length of at least ``power`` - 1 times q. Words and their earlier
    occurrences are the cells of that sparse matrix; a cell prolongs the match of its diagonal, and
    one that ends with sufficient length is a run. So that frequent words do not make the cells
    as many as the square of the words, an occurrence must agree in as many words as half its lag
    or more, which every cell well within a long enough diagonal does. Of those k words, some k in
    each stretch of q have no period up to k / 2, else the whole run had one. With them alone,
    a text of n words has at most 3 n cells for each doubling of the lag, whatever its words.
    """
    if power < 4:
        raise ValueError("runs must have their period at least 4 times")
    # Fewer words cannot hold the shortest run.
    place, lag, size = [], [], []
    at, group = _repeated(keys, np.arange(len(keys)))
    k = 1
    while len(at):
        for p, d in _occurrences(at, group, k):
            fits = power * d <= count[doc[p]]
            place.append(p[fits])
            lag.append(d[fits])
            size.append(np.full(int(fits.sum()), k))
        rank = np.full(len(keys) + k, -1)
        rank[at] = group
        total = int(group[-1]) + 1
        at = np.sort(at)
        at = at[(rank[at + k] >= 0) & (2 * k * power <= count[doc[at]])]
        at = at[doc[at] == doc[at + k]]
        at, group = _repeated(rank[at] * total + rank[at + k], at)
        k *= 2
    none = np.zeros(0, np.int64)
    if not sum(map(len, place)):
        return none, none, none
    first, last, lags = _diagonals(*(np.concatenate(x) for x in (place, lag, size)), doc)
    # Stay within the text; a word needs one a lag before it.
    own = doc[first + lags]
    begin = np.cumsum(count) - count
    first = np.maximum(first, begin[own] + lags)
    last = np.minimum(last, (begin + count)[own])
    found = [np.concatenate(x) for x in zip(*_matches(keys, first, last, lags), strict=True)] if len(first) else [none] * 3
    start, length, period = found[0] - found[2], found[1] + found[2], found[2]
    long = length >= np.maximum(least, power * period)
    start, length, period = start[long], length[long], period[long]
    # A multiple of the period of a run has the same stretch.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def joined(block: W.Block, found: W.Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text of a block, joined by single blanks."""
    start, end, doc = found.start[kept], found.end[kept], found.doc[kept]
    # The byte after a word, a separator of its text, becomes the blank before the next.
    more = np.append(doc[1:] == doc[:-1], False)[: len(doc)]
    edge = np.zeros(len(block.data) + 2, np.int32)
    edge[start] += 1
    np.subtract.at(edge, end + more, 1)
    inside = np.cumsum(edge)[: len(block.data)] > 0
    data = block.data.copy()
    data[end[more]] = 0x20
    sizes = np.bincount(doc, weights=end - start + more, minlength=len(block.rows)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(block.rows), pa.py_buffer(offsets), pa.py_buffer(data[inside]))


def periodic_runs(
    docs: DataFrame, least: int = MIN_LENGTH, power: int = MIN_POWER, carry: list[str] | None = None
) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed, row)``: the periodic runs of words of every text.

    Words are the runs of characters other than blank, tab, line feed, vertical tab, form feed and
    carriage return, numbered from 0. A run ``(start, length, period)`` is a stretch of words
    whose smallest period is ``period`` (words so far apart are equal), of at least ``least`` words
    and ``power`` periods, that neither neighbour prolongs with that period. ``runs`` is sorted by
    start, then period; ``collapsed`` holds the words that no run has after its first period,
    joined by blanks. ``row`` is a struct of the columns named in ``carry``.

    Each row is a text of its own, whether its ``doc_id`` is null or repeated or not. A null text
    has no words: no runs and an empty ``collapsed``. An empty table gives none. Columns that
    are not carried are ignored. Work and memory of a text grow by n log n with its words, also if
    all of them are equal; a text must fit into the memory of a task several times.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column("text")):
                found = W.split(block)
                hashes = W.word_hashes(block, found)
                with np.errstate(over="ignore"):
                    keys = W.mix(hashes ^ (found.doc + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                start, length, period = find_runs(keys, found.doc, found.count, least, power)
                cover = np.zeros(len(keys) + 1, np.int64)
                np.add.at(cover, start + period, 1)
                np.subtract.at(cover, start + length, 1)
                kept = np.cumsum(cover)[:-1] == 0
                own = found.doc[start]
                number = pa.StructArray.from_arrays([pa.array(start - (np.cumsum(found.count) - found.count)[own]), pa.array(length), pa.array(period)], fields=list(_RUN))
                edges = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(block.rows)))]).astype(np.int32)
                a, n = block.rows.start, len(block.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n),
                        pa.array(found.count),
                        pa.ListArray.from_arrays(pa.array(edges), number),
                        joined(block, found, kept),
                        batch.column("row").slice(a, n),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed", "row"],
                )

    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("nothing"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), carried.alias("row")
    )
    result = T.StructType([*T.StructType.fromDDL(_RESULT).fields, T.StructField("row", rows.schema["row"].dataType)])
    return rows.mapInArrow(run, result)
