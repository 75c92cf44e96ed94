"""Removal of repeated passages, against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lexiweight.llm import substring

SCHEMA = "doc_id bigint, text string, row int, keys string"


def brute_force(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for doc, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    result = []
    for doc, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                gone[i : i + window] = [True] * window
        result.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(result, key=str)


def check(spark, rows, window=13):
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA).repartition(3)
    found = substring.remove_repeats(docs, window, carry=["keys", "row"])
    assert found.filter("row.keys <> 'clash' or row.row <> 1").isEmpty()
    found = [tuple(r)[:4] for r in found.collect()]
    assert sorted(found, key=str) == brute_force(rows, window)


def random_rows(seed, vocabulary=6, docs=40):
    rng = random.Random(seed)
    passages = [" ".join(f"p{i}w{j}" for j in range(rng.randint(5, 40))) for i in range(6)]
    rows = []
    for doc in range(docs):
        parts = [" ".join(f"v{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, 30)))]
        parts += rng.sample(passages, rng.randint(0, 3))
        rng.shuffle(parts)
        rows.append((doc * 7 % 101, " \n".join(parts)))
    return rows


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_equals_brute_force(spark, window):
    check(spark, random_rows(window, vocabulary=40 if window < 5 else 4), window)


def test_hot_passage_and_many_copies(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(i, f"a{i} {passage} b{i}") for i in range(200)] + [(1000 + i, passage) for i in range(200)]
    check(spark, rows)


def test_small_portions(spark, monkeypatch):
    """What a task passes on in many portions gives the same result."""
    rows = random_rows(5)
    docs = spark.createDataFrame([(d, t, 1, "") for d, t in rows], SCHEMA)
    monkeypatch.setattr(substring, "MAX_BROADCAST_IDS", -1)
    found = [tuple(r)[:4] for r in substring.remove_repeats(docs, 5).collect()]
    assert sorted(found, key=str) == brute_force(rows, 5)


def test_awkward_rows(spark):
    text = " ".join(str(i) for i in range(20))
    rows = [(1, text), (1, text), (None, text), (None, text), (2, None), (3, ""), (4, " \n"), (5, text.replace(" ", "\t")), (6, "é" * 200_000), (-7, text)]
    check(spark, rows)


def test_no_rows(spark):
    check(spark, [])
    check(spark, [(1, None)])
    check(spark, [(1, "a b")])


def test_block_length():
    """Every window holds a whole aligned block, wherever it starts; no longer block does."""
    for window in range(1, 40):
        size = substring.block_words(window)
        held = lambda n: all(any(i % n == 0 and i + n <= s + window for i in range(s, s + window)) for s in range(n))  # noqa: B023, E731
        assert held(size) and not held(size + 1)


def test_extra_columns_are_ignored(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string").withColumn("bucket", F.lit(None))
    assert substring.remove_repeats(docs).select("doc_id", "kept").collect() == [(1, "a")]
