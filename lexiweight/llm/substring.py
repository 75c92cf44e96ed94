"""Removal of passages that an earlier document has word for word (fixed-block anchors)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweight.llm import words as W
from lexiweight.llm.shared import saved, ship

# Words of a window.
WINDOW = 13
# Tasks exchange their windows in portions of about so many.
PORTION = 1 << 22
# Up to so many document ids are broadcast (8 MB); a longer list is joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000
# Bits of a window's hash that tell anchors apart; the leading ones are the bucket.
MAX_KEY_BITS = 48
# Documents of a portion: their numbers within it and a flag share 16 bits.
MAX_DOCS = 1 << 14

_EXCHANGE = (
    "bucket int, doc_id bigint, keys array<bigint>, entry_keys binary, entry_docs binary, docs binary"
)
_HITS = "doc_id bigint, keys array<bigint>"
_HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("keys", pa.list_(pa.int64()))])
_EXCHANGE_ARROW = pa.schema(
    [
        ("bucket", pa.int32()),
        *_HITS_ARROW,
        ("entry_keys", pa.binary()),
        ("entry_docs", pa.binary()),
        ("docs", pa.binary()),
    ]
)


def block_words(window: int) -> int:
    """The largest block of which every window holds an aligned one whole."""
    return (window + 1) // 2


def _by_document(doc_ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Documents and, for each, the list of its keys."""
    order = np.argsort(doc_ids, kind="stable")
    ids, counts = np.unique(doc_ids, return_counts=True)
    return ids, W.lists(keys[order].view(np.int64), counts, pa.int64())


class _Portion:
    """What a task has found until it passes it on: (key, document, flag) triples."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.size = 0

    def add(self, ids: np.ndarray, key: np.ndarray, doc: np.ndarray, flag: np.ndarray) -> None:
        self.parts.append((key, doc + self.docs, flag))
        self.ids.append(ids)
        self.docs += len(ids)
        self.size += len(key)

    def full(self) -> bool:
        return self.size >= PORTION // 4 or self.docs >= MAX_DOCS

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        key, doc, flag = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids = np.concatenate(self.ids)
        self.__init__()
        return ids, key, doc, flag


def _local(ids: np.ndarray, keys: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows for documents of which the task knows already that they share a key."""
    docs, lists = _by_document(ids, keys)
    nothing = pa.nulls(len(docs), pa.binary())
    to = (W.mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(to), pa.array(docs), lists, nothing, nothing, nothing], schema=_EXCHANGE_ARROW
    )


def _entries(
    ids: np.ndarray, doc: np.ndarray, keys: np.ndarray, buckets: np.ndarray, flag: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """One row for each bucket: its keys, and for each key a document and a flag in 16 bits."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=1 << 40))
    rows = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        used, local = np.unique(doc[own], return_inverse=True)
        rows.append(
            {
                "bucket": int(buckets[own[0]]),
                "entry_keys": keys[own].tobytes(),
                "entry_docs": ((local << 1) | flag[own]).astype(np.uint16).tobytes(),
                "docs": ids[used].tobytes(),
            }
        )
    yield pa.RecordBatch.from_pylist(rows, schema=_EXCHANGE_ARROW)


def _read(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and flags of all entries of a bucket."""
    keys, ids, flags = [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    columns = (table.column(c) for c in ("entry_keys", "entry_docs", "docs"))
    for key, doc, own in zip(*columns, strict=True):
        if key.is_valid:
            code = np.frombuffer(doc.as_py(), np.uint16)
            keys.append(np.frombuffer(key.as_py(), kind))
            ids.append(np.frombuffer(own.as_py(), np.int64)[code >> 1])
            flags.append((code & 1).astype(bool))
    return tuple(np.concatenate(x) for x in (keys, ids, flags))


def _answer(table: pa.Table, ids: np.ndarray, keys: np.ndarray) -> pa.Table:
    """What the tasks knew already, and what this bucket adds."""
    known = table.select(["doc_id", "keys"]).filter(table.column("doc_id").is_valid())
    docs, lists = _by_document(ids, keys.astype(np.uint64))
    added = pa.Table.from_arrays([pa.array(docs), lists], schema=_HITS_ARROW)
    return pa.concat_tables([known.cast(_HITS_ARROW), added])


def _windows(block: W.Block, size: int):
    """Words, word hashes, and the hash and first word of every window of ``size`` words."""
    found = W.split(block)
    hashes = W.word_hashes(block, found)
    at = W.whole_windows(found, size)
    return found, hashes, W.window_hashes(hashes, size)[at], at


def _found(block: W.Block, doc_id: np.ndarray, doc: np.ndarray, portion: _Portion, *columns):
    """Add to a portion what was found in a block; yields whenever the portion is full."""
    ids = doc_id[block.rows.start : block.rows.stop]
    for a in range(0, len(ids), MAX_DOCS):
        own = (doc >= a) & (doc < a + MAX_DOCS)
        portion.add(ids[a : a + MAX_DOCS], columns[0][own], doc[own] - a, columns[1][own])
        if portion.full():
            yield


def _anchors(window: int, bits: int, key_bits: int):
    """Every rolling window of block length, marked if it is one of the text's own blocks."""
    size = block_words(window)
    low_bits = np.uint64(key_bits - bits)

    def emit(portion: _Portion) -> Iterator[pa.RecordBatch]:
        ids, key, doc, block = portion.take()
        if not len(key):
            return
        # By key, then document, its own block first; a document counts once for each key.
        code = (key << np.uint64(16)) | (doc.astype(np.uint64) << np.uint64(1)) | (~block).astype(np.uint64)
        code.sort()
        code = code[np.append(True, (code[1:] ^ code[:-1]) > 1)]
        key, doc = code >> np.uint64(16), ((code >> np.uint64(1)) & np.uint64(0x7FFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        runs = np.diff(np.append(first, len(key)))
        shared = np.repeat(runs > 1, runs)
        if shared.any():
            yield _local(ids[doc[shared]], key[shared], 1 << bits)
        is_block = np.maximum.reduceat((~code & np.uint64(1)).astype(np.int64), first)
        key, doc = key[first], doc[first]
        low = (key & ((np.uint64(1) << low_bits) - np.uint64(1))).astype(np.uint32)
        yield from _entries(ids, doc, low, (key >> low_bits).astype(np.int64), is_block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = _Portion()
        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block in W.blocks(batch.column("text")):
                found, _, key, at = _windows(block, size)
                own_block = found.at[at] % size == 0
                key = key >> np.uint64(64 - key_bits)
                for _ in _found(block, doc_id, found.doc[at], portion, key, own_block):
                    yield from emit(portion)
        if portion.docs:
            yield from emit(portion)

    return run


def _match_anchors(bits: int, key_bits: int):
    """Documents with a window that is a block of some document and occurs in another one too."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, ids, block = _read(table, np.uint32)
        order = np.argsort(low, kind="stable")
        low, ids, block = low[order], ids[order], block[order]
        if len(low):
            first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
            runs = np.diff(np.append(first, len(low)))
            hit = np.repeat((runs > 1) & np.maximum.reduceat(block, first), runs)
            low, ids = low[hit], ids[hit]
        return _answer(table, ids, (key[0].as_py() << (key_bits - bits)) + low.astype(np.uint64))

    return run


def _hit_windows(window: int, bits: int, key_bits: int):
    """Windows around the hits: those that hold a window of block length found elsewhere."""
    size = block_words(window)

    def emit(portion: _Portion) -> Iterator[pa.RecordBatch]:
        ids, key, doc, second = portion.take()
        if not len(key):
            return
        order = np.lexsort((ids[doc], second, key))
        key, doc, second = key[order], doc[order], second[order]
        own = ids[doc]
        new_key = np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1]))
        new_doc = new_key | np.append(True, own[1:] != own[:-1])
        # All but the smallest document of a window are later ones, whatever other tasks find.
        later = new_doc & (own != np.repeat(own[new_key], np.diff(np.append(np.flatnonzero(new_key), len(key)))))
        if later.any():
            yield _local(own[later], key[later], 1 << bits)
        key, doc, second = key[new_key], doc[new_key], second[new_key]
        yield from _entries(ids, doc, key, (second >> np.uint64(64 - bits)).astype(np.int64), np.zeros(len(key), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion = _Portion()
        for batch in batches:
            doc_id = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for block in W.blocks(batch.column("text")):
                found, hashes, key, at = _windows(block, size)
                known = _tagged(batch.column("keys").slice(block.rows.start, len(block.rows)))
                near = np.zeros(len(hashes) + 1, np.int64)
                near[at + 1] = np.isin(_tag(key >> np.uint64(64 - key_bits), found.doc[at]), known)
                near = np.cumsum(near)
                start = W.whole_windows(found, window)
                start = start[near[start + window - size + 1] > near[start]]
                first = W.window_hashes(hashes, window)[start]
                second = W.window_hashes(hashes, window, seed=1)[start]
                for _ in _found(block, doc_id, found.doc[start], portion, first, second):
                    yield from emit(portion)
        if portion.docs:
            yield from emit(portion)

    return run


def _tag(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Key and row in one number."""
    with np.errstate(over="ignore"):
        return W.mix(keys ^ (rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _tagged(lists: pa.Array) -> np.ndarray:
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return _tag(values, np.repeat(np.arange(len(lists)), counts))


def _match_windows(key: tuple, table: pa.Table) -> pa.Table:
    """Windows that a document of this bucket shares with one of a smaller id."""
    keys, ids, _ = _read(table, np.uint64)
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    if len(keys):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        later = ids > np.repeat(ids[first], np.diff(np.append(first, len(keys))))
        keys, ids = keys[later], ids[later]
    return _answer(table, ids, keys)


def _cut(block: W.Block, found: W.Words, gone: np.ndarray) -> pa.Array:
    """The texts of a block without the words that are gone and what separates them from the next word;
    all else stays as it is."""
    after = np.append(found.start[1:], len(block.data))[: len(found.start)]
    after = np.minimum(after, block.offsets[found.doc + 1])
    edge = np.zeros(len(block.data) + 1, np.int64)
    np.add.at(edge, found.start[gone], 1)
    np.subtract.at(edge, after[gone], 1)
    stays = np.cumsum(edge)[:-1] == 0
    offsets = np.concatenate([[0], np.cumsum(stays)])[block.offsets].astype(np.int32)
    return pa.StringArray.from_buffers(len(block.rows), pa.py_buffer(offsets), pa.py_buffer(block.data[stays]))


def _remove(window: int, whole: bool):
    """Words left after the removal of all words that a listed window covers."""

    def block_of(block: W.Block, listed: pa.Array | None) -> list[pa.Array]:
        found = W.split(block)
        gone = np.zeros(len(found.doc), bool)
        if listed is not None:
            keys = W.window_hashes(W.word_hashes(block, found), window)
            start = W.whole_windows(found, window)
            start = start[np.isin(_tag(keys[start], found.doc[start]), _tagged(listed))]
            cover = np.zeros(len(gone) + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
        removed = np.bincount(found.doc[gone], minlength=len(block.rows)).astype(np.int64)
        if whole:
            return [pa.array(found.count), pa.array(removed), _cut(block, found, gone)]
        raw = block.data.tobytes()
        words = [raw[a:b] for a, b in zip(found.start[~gone].tolist(), found.end[~gone].tolist(), strict=True)]
        edges = np.concatenate([[0], np.cumsum(found.count - removed)]).tolist()
        kept = [b" ".join(words[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [
            pa.array(found.count),
            pa.array(removed),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("keys") if "keys" in batch.schema.names else None
            for block in W.blocks(batch.column("text")):
                a, n = block.rows.start, len(block.rows)
                columns = block_of(block, None if listed is None else listed.slice(a, n))
                same = [batch.column(c).slice(a, n) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays(
                    [same[0], *columns, same[1]], names=["doc_id", "n_words", "n_removed", "kept", "row"]
                )

    return run


def _listed(hits: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Keys by document, saved; and the documents, if few enough to broadcast."""
    listed = saved(hits.groupBy("doc_id").agg(F.flatten(F.collect_list("keys")).alias("keys")), name)
    few = listed.count() <= MAX_BROADCAST_IDS
    return listed, F.broadcast(listed.select("doc_id")) if few else None


def earlier_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, keys)``: hashes of the windows of a document that start in one of a smaller id too.

    Blocks of ``block_words(window)`` words that follow each other without overlap are the
    anchors; every window of that length probes them. A window of ``window`` words that two
    documents share holds a block of either, so it lies around a hit in both. The windows around
    hits are then compared whole (by 64 bits of hash and the bucket, which is that of a second
    hash); those that overlap make up the maximal repeats.

    Tasks exchange packed arrays, and each task gathers its own repetitions first, so a passage
    of very many documents reaches a bucket once for each portion of a task.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(5, (size // 6 // PORTION).bit_length())
    key_bits = min(32 + bits, MAX_KEY_BITS)
    probes = texts.mapInArrow(_anchors(window, bits, key_bits), _EXCHANGE)
    hits = probes.groupBy("bucket").applyInArrow(_match_anchors(bits, key_bits), _HITS)
    listed, few = _listed(hits, "anchors")
    own = texts if few is None else texts.join(few, "doc_id", "left_semi")
    around = own.join(listed, "doc_id").mapInArrow(_hit_windows(window, bits, key_bits), _EXCHANGE)
    return around.groupBy("bucket").applyInArrow(_match_windows, _HITS)


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, carry: list[str] | None = None, whole: bool = False
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, row)``: each document without passages of earlier ones.

    Words are the runs of characters other than blank, tab, line feed, vertical tab, form feed
    and carriage return. A word goes if any window of ``window`` words that covers it starts, with
    the same words, in a document with a smaller ``doc_id`` too; ``kept`` joins the rest by
    blanks, or with ``whole`` is the text from which only those words are cut, each with what separates
    it from the next. ``row`` is a struct of the columns named in ``carry``, unchanged.

    A null text has no words. A row without ``doc_id`` has no place in the order: it keeps all
    its words and takes none from others. Rows with the same ``doc_id`` take nothing from each
    other. Windows do not cross from one row to the next. Columns that are not carried are ignored.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("nothing"))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        carried.alias("row"),
    )
    result = T.StructType.fromDDL("doc_id bigint, n_words bigint, n_removed bigint, kept string")
    result = T.StructType([*result.fields, T.StructField("row", texts.schema["row"].dataType)])
    listed, few = _listed(earlier_windows(docs, window), "repeats")
    if few is None:
        return texts.join(listed, "doc_id", "left").mapInArrow(_remove(window, whole), result)
    with_repeats = texts.join(few, "doc_id", "left_semi").join(listed, "doc_id")
    others = texts.join(few, "doc_id", "left_anti")
    return with_repeats.mapInArrow(_remove(window, whole), result).unionByName(
        others.mapInArrow(_remove(window, whole), result)
    )
