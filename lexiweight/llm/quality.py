"""Quality of documents by their nearest labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweight.llm import words as W
from lexiweight.llm.labelled import sample
from lexiweight.llm.shared import ship

# Training documents of each label at most; they bound the model and what is broadcast.
PER_LABEL = 2048
# Hashed terms: the words, and the shapes of the words.
WORD_TERMS, SHAPE_TERMS = 3072, 1024
TERMS = WORD_TERMS + SHAPE_TERMS
# Dimensions of the latent space, and neighbours that vote.
DIMENSIONS, NEIGHBOURS = 64, 25
# Rows of a block of cosine products.
ROWS = 256

# Character classes of a word's shape: upper case, lower case (and all letters beyond ASCII),
# digits; any other character is a class of its own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[0x80:] = ord("a")
_CLASS[ord("0") : ord("9") + 1] = ord("0")


def _shapes(block: W.Block, found: W.Words, keys: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: its runs of one character class, and whether the word before
    is the same."""
    if not len(found.start):
        return np.zeros(0, np.uint64)
    kind = _CLASS[block.data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[found.start] = True
    before = np.concatenate([[0], np.cumsum(change)])
    runs = W.Block(block.rows, kind[change], block.offsets)
    start, end = before[found.start], before[found.end]
    shape = W.word_hashes(runs, W.Words(start, end, found.doc, found.at, found.count), seed=5)
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (found.at[1:] > 0)
    return W.mix(shape ^ again.astype(np.uint64))


def term_counts(block: W.Block) -> np.ndarray:
    """Occurrences of every hashed term in every text of a block."""
    found = W.split(block)
    keys = W.word_hashes(block, found)
    rows = len(block.rows)
    word = (keys % np.uint64(WORD_TERMS)).astype(np.int64)
    shape = (_shapes(block, found, keys) % np.uint64(SHAPE_TERMS)).astype(np.int64) + WORD_TERMS
    at = found.doc * TERMS
    counts = np.bincount(np.concatenate([at + word, at + shape]), minlength=rows * TERMS)
    return counts.reshape(rows, TERMS).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    length = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


@dataclass
class Space:
    """A latent space and the labelled vectors in it."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """TF-IDF of words and of shapes, either at length 1."""
        x = np.log1p(counts, out=counts)
        x *= self.idf
        return np.concatenate([_unit(x[:, :WORD_TERMS]), _unit(x[:, WORD_TERMS:])], axis=1)

    def place(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self.weigh(counts) @ self.axes)

    def vote(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """The labels of the nearest vectors, weighted by their cosine.

        Texts without a word are near to nothing: they get the mean of all labels."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.place(counts) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, nearest, axis=1), 0).astype(np.float64)
        total = weight.sum(axis=1)
        votes = (weight * self.labels[nearest]).sum(axis=1)
        return np.divide(votes, total, out=np.full(len(counts), self.labels.mean()), where=total > 0)


def _axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors of ``x`` (randomized subspace iteration)."""
    rng = np.random.default_rng(0)
    k = min(dimensions, *x.shape)
    basis = rng.standard_normal((x.shape[1], min(k + 16, x.shape[1]))).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ right.T)[:, :k].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL) -> Space:
    """Learn the space from a bounded sample: at most ``per_label`` training documents of each label.

    Term counts of the sample, at most ``2 * per_label`` rows of ``TERMS`` numbers, come to one task, which
    learns the space; the driver gets the axes and the labelled vectors only. Frequencies of the terms
    are those of the sample, which are part of the fitted model.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column("text"), rows=ROWS):
                counts = np.minimum(term_counts(block), 65535)
                row, term = np.nonzero(counts)
                per_row = np.bincount(row, minlength=len(counts)).tolist()
                edges = np.concatenate([[0], np.cumsum(per_row)]).tolist()
                value = counts[row, term].astype(np.uint16)
                cells = [
                    term[a:b].astype(np.uint16).tobytes() + value[a:b].tobytes()
                    for a, b in zip(edges[:-1], edges[1:], strict=True)
                ]
                own = batch.slice(block.rows.start, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("label"), pa.array(cells, pa.binary())],
                    names=["doc_id", "label", "cells"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["doc_id"], r["label"], r["cells"]) for batch in batches for r in batch.to_pylist())
        if not rows:
            return
        x = np.zeros((len(rows), TERMS), np.float32)
        for i, (_, _, cells) in enumerate(rows):
            term, value = np.frombuffer(cells, np.uint16).reshape(2, -1)
            x[i, term] = value
        known = np.array([own for _, own, _ in rows], np.float64)
        frequency = np.count_nonzero(x, axis=0)
        idf = np.log((1 + len(x)) / (1 + frequency)).astype(np.float32) + np.float32(1)
        weighed = Space(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), known).weigh(x)
        axes = _axes(weighed, DIMENSIONS)
        parts = (idf, axes, _unit(weighed @ axes), known)
        yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["idf", "axes", "vectors", "labels"])

    counted = sample(docs, labels, label, per_label).mapInArrow(count, "doc_id bigint, label int, cells binary")
    fitted = counted.repartition(1).mapInArrow(learn, "idf binary, axes binary, vectors binary, labels binary").first()
    if fitted is None:
        return Space(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    idf, axes, vectors = (np.frombuffer(fitted[c], np.float32) for c in ("idf", "axes", "vectors"))
    known = np.frombuffer(fitted["labels"], np.float64)
    return Space(idf, axes.reshape(TERMS, -1), vectors.reshape(len(known), -1), known)


def score(docs: DataFrame, space: Space, carry: list[str] | None = None) -> DataFrame:
    """The columns named in ``carry`` (all by default) in a struct ``row``, and ``score``, the vote for label 1 (0 to 1).

    Every whole text is placed in the space and compared with all labelled vectors, a block at a
    time; the vectors are broadcast, at most ``2 * PER_LABEL * DIMENSIONS`` numbers. Null, empty
    and blank texts get the mean of the labels, or 0.5 if there are none. Repeated rows get equal
    scores, and no column but ``text`` takes part.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, row = batch.column("text"), batch.column("row")
            for block in W.blocks(text, rows=ROWS):
                votes = model.value.vote(term_counts(block))
                own = row.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([own, pa.array(votes)], names=["row", "score"])

    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    result = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, result)
