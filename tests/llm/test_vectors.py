"""Embeddings: near-duplicates against all pairs, neighbours against all distances."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiweight.llm import cells, collisions

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep int, cell string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "c") for i, v in rows], SCHEMA)


def clustered(seed, n, copies, width=16, noise=0.02):
    rng = np.random.default_rng(seed)
    rows = list(rng.standard_normal((n, width)).astype(np.float32))
    for _ in range(copies):
        rows.append((rows[rng.integers(min(6, n))] + noise * rng.standard_normal(width)).astype(np.float32))
    ids = rng.permutation(10 * len(rows))[: len(rows)]
    return [(int(i), v.tolist()) for i, v in zip(ids, rows, strict=True)]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def all_pairs(rows, cosine=cells.COSINE):
    usable = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and good(v)]
    links = {}
    parent = list(range(len(usable)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    counts = [0] * len(usable)
    for i, (_, a) in enumerate(usable):
        for j in range(i):
            b = usable[j][1]
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= cosine - 1e-12:
                counts[i] += 1
                counts[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(usable):
        least[find(i)] = min(d, least.get(find(i), d))
    out = [(d, counts[i], least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(usable)]
    out += [(d, 0, d, True) for d, v in rows if d is None or not good(v)]
    return sorted(out, key=str)


def check_links(spark, rows):
    found = [tuple(r) for r in cells.near_vectors(table(spark, rows)).collect()]
    assert sorted(found, key=str) == all_pairs(rows)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    rows = clustered(1, 150, 250, noise=0.2)
    assert max(r[1] for r in all_pairs(rows)) > 20
    check_links(spark, rows)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_of_few_directions(spark, monkeypatch, block):
    """Vectors of 4 out of 256 directions, many of them linked across the borders of cells."""
    monkeypatch.setattr(cells, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((500, 4)) @ rng.standard_normal((4, 256))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert max(r[1] for r in all_pairs(rows)) > 5
    check_links(spark, rows)


ODD = [
    (1, [1, 0]), (2, [2, 0]), (2, [2, 0]), (3, [1, 0]), (4, None), (5, []), (6, [0, 0]), (7, [1, None]), (8, [float("nan"), 1]),
    (9, [float("inf"), 1]), (None, [1, 0]), (10, [1, 0, 0]), (11, [3, 0, 0]), (12, [-1, 0]), (13, [1e-30, 0]), (14, [1e30, 1e29]), (15, [7]),
]


def test_odd_vectors(spark):
    check_links(spark, ODD)
    check_links(spark, [])
    check_links(spark, [(1, None), (2, [0, 0])])
    check_links(spark, [(4, [1, 2])])


def test_equal_cosines_at_the_threshold(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)]
    check_links(spark, rows)


def all_distances(rows, chosen, k):
    usable = {}
    for i, v in rows:
        if i is not None and good(v):
            usable[i] = min(usable.get(i, v), v)
    out = {}
    for i, v in usable.items():
        if chosen(i):
            near = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(map(float, v), map(float, w), strict=True))), j) for j, w in usable.items() if j != i and len(w) == len(v)]
            out[i] = sorted(near)[:k]
    return out


def search(spark, rows, k=10):
    found = {}
    for r in collisions.nearest(table(spark, rows), F.col("vec_id") % 3 == 0, k).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(v) for q, v in found.items()}


@pytest.mark.parametrize("block", [64, 8192])
def test_recall_and_distances(spark, monkeypatch, block):
    monkeypatch.setattr(collisions, "BLOCK", block)
    monkeypatch.setattr(collisions, "QUERIES", 50)
    rows = clustered(2, 400, 100, width=32)
    exact = all_distances(rows, lambda i: i % 3 == 0, 10)
    found = search(spark, rows)
    assert found.keys() == exact.keys()
    hits = total = 0
    for q, near in exact.items():
        assert [r for r, _, _ in found[q]] == list(range(1, 11))
        assert found[q] == sorted(found[q], key=lambda x: (x[2], x[1]))
        hits += len({j for _, j in near} & {j for _, j, _ in found[q]})
        total += len(near)
        own = {j: d for d, j in all_distances(rows, lambda i: i == q, 10**6)[q]}  # noqa: B023
        assert all(score == pytest.approx(own[j], abs=1e-9) for _, j, score in found[q])
    assert hits / total >= 0.95


def test_odd_and_few_vectors(spark):
    exact = all_distances(ODD, lambda i: i % 3 == 0, 10)
    found = search(spark, ODD)
    assert {q: [j for _, j, _ in v] for q, v in found.items()} == {q: [j for _, j in v] for q, v in exact.items() if v}
    assert search(spark, []) == {} and search(spark, [(3, [1.0])]) == {}


def test_ties_go_to_the_smaller_id(spark):
    rows = [(0, [0.0, 1.0])] + [(i, [1.0, 0.0]) for i in range(100, 160, 2)] + [(i, [2.0, 0.0]) for i in range(1, 30, 3)]
    assert [j for _, j, _ in search(spark, rows)[0]] == list(range(100, 120, 2))


def test_recall_function(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "query_id bigint, vec_id bigint")
    assert collisions.recall(a.limit(1), a) == 0.5
