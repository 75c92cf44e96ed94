"""Near-duplicate documents, against all pairs on small tables."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexiweight.llm import graph, minhash
from lexiweight.llm import words as W

SCHEMA = "doc_id bigint, text string, rep int, band string"


def words_of(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def weights(text, frequencies):
    (block,) = W.blocks(pa.array([text]))
    found = minhash.shingles(block)
    return dict(zip(found.key.tolist(), frequencies.weight(found).tolist(), strict=True))


def similarity(a, b):
    keys = set(a) | set(b)
    low = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys)
    return low / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def classes_by_force(rows, frequencies):
    rows = [(d, t) for d, t in rows if d is not None and t and t.split()]
    own = [weights(t, frequencies) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(own[i], own[j]) >= minhash.SIMILARITY:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def corpus(seed):
    """Texts of which some are changed copies, in chains: a copy of a copy of a copy."""
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(25):
        text = words_of(rng, rng.randint(3, 120))
        for _ in range(rng.choice([1, 1, 2, 8])):
            rows.append((doc * 13 % 997, " ".join(text)))
            doc += 1
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words_of(rng, 3))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 0, "clash") for d, t in rows], SCHEMA)
    frequencies = minhash.document_frequencies(docs)
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert found == classes_by_force(rows, frequencies)


def test_links_between_classes_are_not_lost(spark, monkeypatch):
    """With one band, whose hub is far from many others, the later step must find what the comparison
    with the hub does not."""
    rng = random.Random(5)
    base = words_of(rng, 60)
    rows = []
    for i in range(30):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = "new" + str(i)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)
    frequencies = minhash.document_frequencies(docs)
    monkeypatch.setattr(minhash, "_signed", _signed_in_one_band(minhash._signed))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert found == classes_by_force(rows, frequencies)


def _signed_in_one_band(signed):
    def make(frequencies):
        def run(batches):
            for batch in signed(frequencies)(batches):
                bands = pa.array([[1] * minhash.BANDS] * batch.num_rows, pa.list_(pa.int64()))
                columns = [bands if n == "bands" else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return run

    return make


def test_awkward_rows(spark):
    long = " ".join(words_of(random.Random(1), 60_000))
    rows = [(5, "a b c"), (3, "a  b\nc"), (3, "a  b\nc"), (4, None), (6, ""), (7, " "), (8, ""), (None, "a b c"), (None, None), (9, long), (2, long + " x"), (10, "a b")]
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)
    found = sorted(((r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    classes = {5: 3, 9: 2}
    assert found == sorted(((d, classes.get(d, d), d not in classes) for d, _ in rows), key=str)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([3, 4, 6, 7, 8, None, None, 2, 10], key=str)


def test_two_texts_under_one_id(spark):
    rng = random.Random(2)
    x, y = (" ".join(words_of(rng, 40)) for _ in range(2))
    rows = [(5, x), (5, y), (7, x + " end"), (8, "start " + y), (9, "nothing like it")]
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)
    found = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    assert found == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_empty_tables(spark):
    for rows in ([], [(1, None, 0, "")]):
        docs = spark.createDataFrame(rows, SCHEMA)
        assert minhash.near_duplicates(docs).count() == len(rows) == minhash.drop_near_duplicates(docs).count()


def test_samples_agree_as_often_as_texts_are_similar(spark):
    rng = random.Random(9)
    a = words_of(rng, 200)
    b = a[:150] + words_of(rng, 50)
    (block,) = W.blocks(pa.array([" ".join(a), " ".join(b)]))
    found = minhash.shingles(block)
    tables = np.random.default_rng(0).uniform(1, 6, (2, minhash.COUNTERS)).astype(np.float32)
    frequencies = minhash.Frequencies(np.zeros((2, minhash.COUNTERS), np.int32), tables)
    edges = np.flatnonzero(np.append(True, found.doc[1:] != found.doc[:-1]))
    log_weight = np.log(frequencies.weight(found)).astype(np.float32)
    drawn = [minhash._sample(found.key, log_weight, edges, s) for s in W.stream(77, 1500)]
    share = np.mean([x[0] == x[1] for x in drawn])
    true = similarity(weights(" ".join(a), frequencies), weights(" ".join(b), frequencies))
    assert share == pytest.approx(true, abs=0.04)


def test_frequencies_count_documents(spark):
    rows = [(i, f"a b c d e u{i} v{i} w{i} x{i} y{i}") for i in range(40)] + [(100 + i, f"l{i} m n o p q") for i in range(60)]
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)
    frequencies = minhash.document_frequencies(docs)
    got = Counter(round(w, 3) for w in weights("a b c d e", frequencies).values())
    assert list(got) == [round(1 - np.log(0.4), 3)]
    got = list(weights("never seen before at all", frequencies).values())
    assert got == [pytest.approx(1 - np.log(minhash.RARE))]


def test_exact_copies_do_not_part_their_variants(spark):
    """Two variants whose plain similarity is 0.83 stay in one class however many copies there are,
    also copies that differ in white space."""
    rng = random.Random(4)
    base = words_of(rng, 100)
    variants = [" ".join(base), " ".join([*base[:91], *words_of(rng, 9)])]
    rows = [(i, variants[0].replace(" ", " " * (1 + i % 2))) for i in range(60)] + [(100, variants[1])]
    rows += [(200 + i, " ".join(words_of(rng, 30))) for i in range(40)]
    docs = spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)
    frequencies = minhash.document_frequencies(docs)
    different = spark.createDataFrame([(d, t, 0, "") for d, t in rows if d == 0 or d >= 100], SCHEMA)
    assert weights(variants[0], frequencies) == weights(variants[0], minhash.document_frequencies(different))
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert found == {d: 0 if d <= 100 else d for d, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)] + [(200, i) for i in range(201, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    linked = {x for a, b in edges for x in (a, b) if a != b}
    assert found == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    assert graph.components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).collect() == []
