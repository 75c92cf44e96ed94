"""Toxicity of documents: a linear classifier over character n-grams scaled by log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweight.llm import words as W
from lexiweight.llm.labelled import held_out, sample
from lexiweight.llm.shared import ship

# Training documents of each label at most, hashed n-grams, and those that the classifier keeps.
PER_LABEL = 4000
BUCKETS = 1 << 18
FEATURES = 8192
LENGTHS = (3, 4, 5, 6)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LOWER[0x09:0x0E] = 0x20


def _grams(block: W.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams and their rows, for one length after the other.

    Letters A-Z are lowered, white space is a blank, and every text begins and ends with one.
    """
    rows = len(block.rows)
    length = np.diff(block.offsets)
    edges = np.concatenate([[0], np.cumsum(length + 2)])
    data = np.full(edges[-1], 0x20, np.uint8)
    row = np.repeat(np.arange(rows, dtype=np.int32), length + 2)
    data[np.arange(len(block.data)) + np.repeat(2 * np.arange(rows) + 1, length)] = _LOWER[block.data]
    value = W.stream(11, 256)[data]
    factor = W.stream(12, 1)[0] | np.uint64(1)
    with np.errstate(over="ignore"):
        key = value.copy()
        for n in range(2, max(LENGTHS) + 1):
            key = key[:-1] * factor + value[n - 1 :]
            if n in LENGTHS:
                whole = row[: len(key)] == row[n - 1 :]
                yield (W.mix(key[whole]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), row[: len(key)][whole]


def _present(codes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, code) once."""
    both = np.unique(rows.astype(np.int64) * size + codes)
    return both // size, both % size


@dataclass
class Classifier:
    """Weight of each hashed n-gram (0 for most), and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, block: W.Block) -> np.ndarray:
        total = np.full(len(block.rows), self.intercept)
        found = [], []
        for codes, rows in _grams(block):
            own = self.weights[codes] != 0
            found[0].append(rows[own])
            found[1].append(codes[own])
        rows, codes = _present(np.concatenate(found[1]), np.concatenate(found[0]), BUCKETS)
        total += np.bincount(rows, self.weights[codes], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def _presence(found: DataFrame) -> np.ndarray:
    """Documents of each label that hold an n-gram, by bucket: 2 x BUCKETS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            label = batch.column("label").to_numpy()
            for block in W.blocks(batch.column("text")):
                own = label[block.rows.start : block.rows.stop]
                for codes, rows in _grams(block):
                    row, code = _present(codes, rows, BUCKETS)
                    for v in (0, 1):
                        counts[v] += np.bincount(code[own[row] == v], minlength=BUCKETS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], names=["counts"])

    # One row from each of the few tasks of the sample.
    parts = found.mapInArrow(run, "counts binary").collect()
    return sum((np.frombuffer(p.counts, np.int32).reshape(2, -1) for p in parts), np.zeros((2, BUCKETS), np.int64))


def _cells(found: DataFrame, chosen: np.ndarray) -> list:
    """For each document of the sample, which of the chosen n-grams it holds."""
    number = np.full(BUCKETS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    model = found.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in W.blocks(batch.column("text")):
                rows, codes = [], []
                for code, row in _grams(block):
                    own = model.value[code]
                    rows.append(row[own >= 0])
                    codes.append(own[own >= 0])
                row, code = _present(np.concatenate(codes), np.concatenate(rows), FEATURES)
                counts = np.bincount(row, minlength=len(block.rows))
                edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
                code = code.astype(np.uint16)
                cells = [code[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
                own = batch.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("label"), pa.array(cells, pa.binary())],
                    names=["doc_id", "label", "cells"],
                )

    rows = found.mapInArrow(run, "doc_id bigint, label int, cells binary").collect()
    return sorted(rows, key=lambda r: (r.doc_id, r.label))


def _logistic(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression on 0/1 features times ``scale``, both labels weighing alike."""
    column = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = scale[column]
    share = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    weight, intercept = np.zeros(len(scale)), 0.0
    first, second = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):  # Adam, full batch
        total = intercept + np.bincount(row, value * weight[column], len(rows))
        error = share * (1 / (1 + np.exp(-np.clip(total, -50, 50))) - label) / len(rows)
        slope = np.append(np.bincount(column, value * error[row], len(scale)) + 1e-4 * weight, error.sum())
        first += 0.1 * (slope - first)
        second += 0.01 * (slope**2 - second)
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        weight -= step[:-1]
        intercept -= step[-1]
    return weight, intercept


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL) -> Classifier:
    """Learn from a bounded sample: at most ``per_label`` training documents of each label.

    The ratio of an n-gram is log((p + 1) / P) - log((q + 1) / Q) with p of P documents of label 1
    and q of Q of label 0 that hold it. The n-grams whose presence tells most about the label (log
    likelihood ratio) become features, scaled by their ratio. The share of label 1 among all
    training labels sets the intercept. With labels of one kind only, that share is every score.
    """
    train = labels.filter(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
    counted = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("int")).alias("positive")).first()
    prior = ((counted.positive or 0) + 0.5) / (counted.n + 1)
    odds = float(np.log(prior / (1 - prior)))
    found = sample(docs, labels, label, per_label)
    kinds = {r.label: r.n for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return Classifier(np.zeros(BUCKETS), odds)
    q, p = _presence(found).astype(float)
    size = np.array([kinds[0], kinds[1]], float)
    ratio = np.log((p + 1) / (size[1] + 2)) - np.log((q + 1) / (size[0] + 2))
    both = (p + q) / size.sum()
    gain = sum(
        part * np.log(np.maximum(part, 1e-9) / np.maximum(n * share, 1e-9))
        for n, own in ((size[0], q), (size[1], p))
        for part, share in ((own, both), (n - own, 1 - both))
    )
    chosen = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
    cells = _cells(found, chosen)
    rows = [np.frombuffer(r.cells, np.uint16) for r in cells]
    weight, intercept = _logistic(rows, np.array([r.label for r in cells], float), ratio[chosen])
    weights = np.zeros(BUCKETS)
    weights[chosen] = weight * ratio[chosen]
    return Classifier(weights, intercept + odds)


def score(docs: DataFrame, classifier: Classifier, carry: list[str] | None = None) -> DataFrame:
    """The columns named in ``carry`` (all by default) in a struct ``row``, and ``score``, the probability of label 1.

    Whole texts are scored, a block at a time; the weights are broadcast (``BUCKETS`` numbers). A
    null text counts as an empty one, which the intercept alone decides. Repeated rows get equal
    scores, and no column but ``text`` takes part.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            for block in W.blocks(batch.column("text")):
                scores = model.value.score(block)
                own = row.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([own, pa.array(scores)], names=["row", "score"])

    rows = docs.select(F.struct(*(carry or docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    result = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, result)
