"""Periodic runs, collocations and fingerprints against brute force and SQL."""

from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from lexiweight.llm import collocations as C  # noqa: E402
from lexiweight.llm import fingerprints as P  # noqa: E402
from lexiweight.llm import queries as Q  # noqa: E402
from lexiweight.llm import runs as R  # noqa: E402

duckdb = pytest.importorskip("duckdb")
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
# Every column that an operator makes, as a column of the input.
CLASH = {c: "string" for c in ("words", "runs", "collapsed", "row", "n_words", "phrase", "rank", "count", "range", "tie", "key", "sketch", "edited", "first", "place", "h", "w", "n", "a", "p")}


def documents(spark, rows, partitions=3):
    """Documents from (doc_id, text, lang), with columns of every name that the operators use."""
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(partitions)
    return table.withColumns({c: F.lit("clash").cast(kind) for c, kind in CLASH.items()})


def in_duckdb(rows, sql):
    import pandas as pd

    connection = duckdb.connect()
    connection.register("given", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]))
    connection.execute("create view documents as select doc_id::bigint as doc_id, text::varchar as text, lang::varchar as lang from given")
    result = connection.sql(sql)
    return [dict(zip(result.columns, row, strict=True)) for row in result.fetchall()]


# --- periodic runs -----------------------------------------------------------------------------


def brute_runs(words, least=6, power=4):
    found = {}
    for q in range(1, len(words) // power + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, kinds = rng.randint(0, 70), rng.choice([1, 2, 3, 5, 40])
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        for i in range(a, rng.randint(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 4))]
        count = np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(len(texts)), count)
        keys = np.array([hash((d, w)) for d, t in enumerate(texts) for w in t], np.int64)
        least, power = rng.choice([(6, 4), (1, 4), (20, 5)])
        found = defaultdict(list)
        begin = np.cumsum(count) - count
        for s, n, q in zip(*(x.tolist() for x in R.find_runs(keys, doc, count, least, power)), strict=True):
            found[int(doc[s])].append((s - int(begin[doc[s]]), n, q))
        assert [found[d] for d in range(len(texts))] == [brute_runs(t, least, power) for t in texts]


@pytest.mark.parametrize(
    "words",
    [[0] * 200_000, ([0] * 50 + [1]) * 4000, sum(([0] * 400 + [i] for i in range(1, 500)), []), list(range(200_000))],
    ids=["one word", "a word apart", "runs apart", "all different"],
)
def test_cells_grow_with_the_words(monkeypatch, words):
    """Whatever a text repeats, its cells are fewer than three for each word and doubling of the lag."""
    cells = []
    own = R._occurrences

    def counted(at, group, size):
        for place, lag in own(at, group, size):
            cells.append(len(place))
            yield place, lag

    monkeypatch.setattr(R, "_occurrences", counted)
    R.find_runs(np.array(words), np.zeros(len(words), np.int64), np.array([len(words)]))
    assert sum(cells) <= 3 * len(words) * np.log2(len(words))


def test_runs_of_texts(spark):
    rng = random.Random(9)
    texts = ["", None, " \t\n ", "a a a a a a", "é é é é é é é", "x " * 3000, "a b " * 7 + "c", " ".join(["no"] * 5)]
    texts += [" ".join(random_words(rng)) for _ in range(60)] + ["\r\n".join(random_words(rng) * 3) for _ in range(20)]
    rows = [(None if i % 9 == 0 else i // 2, t, "en") for i, t in enumerate(texts)]
    found = R.periodic_runs(documents(spark, rows), carry=["text", "runs"]).collect()
    assert len(found) == len(rows)
    assert Counter((r.doc_id, r.row.text) for r in found) == Counter((d, t) for d, t, _ in rows)
    for r in found:
        words = SPLIT.findall(r.row.text or "")
        expected = brute_runs(words)
        gone = {i for s, n, q in expected for i in range(s + q, s + n)}
        assert r.row.runs == "clash" and r.n_words == len(words)
        assert [tuple(x) for x in r.runs] == expected
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_query_equals_sql(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", " ".join(random_words(rng)), "\t".join(random_words(rng) * 4)]), "en") for i in range(300)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    ours = [r.asDict() for r in Q.op11_periodic_runs(spark, str(tmp_path)).collect()]
    theirs = in_duckdb(rows, Q.periodic_runs_sql())
    assert sorted(ours, key=lambda r: r["doc_id"]) == sorted(theirs, key=lambda r: r["doc_id"])


def test_no_documents(spark):
    empty = documents(spark, [])
    assert R.periodic_runs(empty).collect() == []
    assert C.collocations(empty).collect() == []
    assert P.compare_with_next(empty).collect() == []


# --- collocations ------------------------------------------------------------------------------


def brute_collocations(rows, least, longest, top, percent):
    counts, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    result = []
    for lang, f in counts.items():
        candidates = {p for p, a in f.items() if len(p) > 1 and a >= least}
        gone = set()
        for longer in candidates:
            for size in range(2, len(longer)):
                for i in range(len(longer) - size + 1):
                    part = longer[i : i + size]
                    if 100 * f[longer] >= percent * f[part]:
                        gone.add(part)
        scored = []
        for p in candidates - gone:
            cuts = [(1000 * f[p] * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(result)


def random_prose(rng, n):
    words = ["the", "The", "of", "new", "york", "New", "san", "francisco", "é", "ß", "x-y", "'s"] + [f"w{i}" for i in range(30)]
    text = []
    for _ in range(n):
        text.append(rng.choice(words[:12] if rng.random() < 0.7 else words))
        text.append(rng.choice([" "] * 8 + ["\t", "  ", ". ", ", ", "\n", "!?", "\x0b", " "]))
    return "".join(text)


@pytest.mark.parametrize(("least", "longest", "top", "percent"), [(5, 5, 2000, 100), (3, 3, 7, 60), (4, 2, 5, 100), (300, 5, 10, 100), (2, 1, 5, 100)])
def test_collocations_equal_brute_force(spark, least, longest, top, percent):
    rng = random.Random(least)
    rows = [(i % 50, rng.choice([None, "", random_prose(rng, rng.randint(0, 120))]), rng.choice(["en", "en", "en", "fr", None, "und", ""])) for i in range(120)]
    rows += [(1, "same row of words again", "de")] * 20 + [(2, "word " * 5000, "fr")]
    found = C.collocations(documents(spark, rows), least, longest, top, percent)
    assert sorted(map(tuple, found.collect())) == brute_collocations(rows, least, longest, top, percent)


def test_filters_only_save_work(spark, monkeypatch):
    """The same result with filters that hold nearly everything, and with small portions."""
    rng = random.Random(2)
    rows = [(i, random_prose(rng, 80), "en") for i in range(60)]
    expected = brute_collocations(rows, 4, 5, 2000, 100)
    monkeypatch.setattr(C, "MIN_FILTER_BITS", 64)
    monkeypatch.setattr(C, "MAX_FILTER_BITS", 64)
    monkeypatch.setattr(C, "PORTION", 64)
    monkeypatch.setattr(C, "PORTION_BYTES", 500)
    assert sorted(map(tuple, C.collocations(documents(spark, rows), 4).collect())) == expected


def test_products_beyond_64_bits(spark, monkeypatch):
    """Scores stay exact where 1000 * a * n and l * r are larger than 64 bits hold."""
    a, l, r, n = 3_000_000_019, 4_000_000_007, 9_000_000_001, 10**13 + 37
    table = spark.createDataFrame([("en", 1, "", "x", "x", l), ("en", 1, "", "y", "y", r), ("en", 2, "x", "y", "x y", a)], "lang string, size int, prefix string, word string, phrase string, count bigint")
    sizes = spark.createDataFrame([("en", n)], "lang string, n bigint")
    monkeypatch.setattr(C, "frequent_phrases", lambda *args: (table, sizes))
    rows = C.collocations(documents(spark, [])).collect()
    assert [tuple(x) for x in rows] == [("en", 1, "x y", a, l, r, n, 1000 * a * n // (l * r))]


# --- fingerprints ------------------------------------------------------------------------------


def sketch_of(text, shingle=5, k=128):
    words = SPLIT.findall(text or "")
    parts = {" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return sorted(hashlib.md5(p.encode()).hexdigest()[:16] for p in parts)[:k], parts


def brute_fingerprints(rows):
    order = sorted(((d, t or "") for d, t, _ in rows), key=lambda r: -r[0])
    result = {}
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other, next_one = (sketch_of(t)[0] for t in (text, edited, following))

        def alike(a, b):
            union = sorted(set(a) | set(b))[:128]
            return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0

        result[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(other), alike(own, other), alike(own, next_one))
    return result


@pytest.mark.parametrize("partitions", [1, 5])
def test_fingerprints_equal_brute_force(spark, partitions):
    rng = random.Random(partitions)
    texts = [" ".join(rng.choice(["ä", "b", "c😀", "dd", "e"]) + str(rng.randrange(40)) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    rows = [(i * 7 - 300, rng.choice(texts + [None, "", "one"]), "en") for i in range(200)]
    rows[50] = (rows[50][0], "long words " * 20_000 + "é", "en")
    rows[51] = (rows[51][0], rows[50][1], "en")
    found = P.compare_with_next(documents(spark, rows, partitions)).collect()
    expected = brute_fingerprints(rows)
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == expected[r.doc_id]


def test_fingerprint_query_equals_sql(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, "", random_prose(rng, rng.randint(0, 400))]), "en") for i in range(80)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    ours = sorted((r.asDict() for r in Q.op13_fingerprints(spark, str(tmp_path)).collect()), key=lambda r: r["doc_id"])
    theirs = sorted(in_duckdb(rows, Q.fingerprints_sql()), key=lambda r: r["doc_id"])
    assert [{k: r[k] for k in sorted(r)} for r in ours] == [{k: r[k] for k in sorted(r)} for r in theirs]


def test_one_document_follows_itself(spark):
    row = P.compare_with_next(documents(spark, [(5, "abcd", "en")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0


def test_a_hot_id_is_dealt_out(spark):
    """Rows without an id, and those of one id, are spread over ranges in proportion to their number."""
    rows = [(None, f"a {i}", "en") for i in range(4000)] + [(77, "same", "en")] * 4000 + [(i, f"b {i}", "en") for i in range(4000)]
    ranges = P._ranges(documents(spark, rows)).groupBy("range").count().collect()
    assert len(ranges) == 8 and max(r["count"] for r in ranges) < 2 * 12_000 / 8
    found = P.compare_with_next(documents(spark, rows))
    assert found.count() == 12_000 and found.filter("doc_id is null").count() == 4000
    assert found.filter("doc_id = 77 and near_next = 1").count() >= 3998


def test_sketches_merge(spark):
    """The sketch of a whole from those of its parts, also if one key has most parts."""
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(3000)) for _ in range(60)), "a" if i % 10 else "b") for i in range(300)]
    rows += [(500, None, "none"), (501, "", "none"), (502, "x", None)]
    parts = P.with_sketch(documents(spark, rows).drop("sketch"), "text", "sketch")
    merged = {r.lang: r.sketch for r in P.merged_sketches(parts, ["lang"]).collect()}
    for lang in ("a", "b", "none", None):
        expected = set().union(*(sketch_of(t)[1] for _, t, own in rows if own == lang))
        assert merged[lang] == sorted(hashlib.md5(p.encode()).hexdigest()[:16] for p in expected)[:128]
        if len(expected) > 128:
            estimate = spark.range(1).select(P.distinct_shingles(F.lit(merged[lang]))).first()[0]
            assert abs(estimate - len(expected)) < 0.3 * len(expected)
    pair = spark.range(1).select(F.lit(merged["a"]).alias("a"), F.lit(merged["b"]).alias("b")).withColumn("u", P.merge(F.col("a"), F.col("b")))
    both = pair.select("u", P.from_text(P.as_text(F.col("a"))).alias("back"), "a").first()
    assert both.back == both.a
    assert both.u == sorted(set(merged["a"]) | set(merged["b"]))[:128]


def test_estimates(spark):
    """Resemblance and containment of sets that overlap by a known share."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(1, " ".join(words), "en"), (2, " ".join(words[:2000]), "en")]
    table = P.with_sketch(documents(spark, rows).drop("sketch"), "text", "sketch").select("doc_id", "sketch")
    one, two = (table.filter(F.col("doc_id") == d).select(F.col("sketch").alias(f"s{d}")) for d in (1, 2))
    a, b, u = F.col("s1"), F.col("s2"), F.col("u")
    row = one.join(two).withColumn("u", P.merge(a, b)).select(P.resemblance(a, b, u).alias("alike"), P.containment(b, a, u).alias("within"), P.containment(a, b, u).alias("holds")).first()
    assert abs(row.alike - 0.5) < 0.13 and row.within > 0.75 and abs(row.holds - 0.5) < 0.15
