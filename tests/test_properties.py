"""Properties of the analytic, against brute force on random corpora."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiweight import operators as op
from lexiweight import term_counts, term_weights, term_weights_staged
from lexiweight.operators import lookup
from lexiweight.plans import merged_documents, merged_frequency, merged_size, merged_weights, write_slice


def random_rows(seed, hot=False):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["a@b", "x/y", "foo@", "@", "p=q"]
    rows = []
    for corpus in ("c0", "c1", "c2"):
        for document in range(rng.randint(1, 12)):
            chosen = [rng.choice(vocabulary) for _ in range(rng.randint(0, 25))]
            chosen += ["the"] * (40 if hot else rng.randint(0, 2))
            rows.append((corpus, f"d{document}", " ".join(chosen)))
    return rows


def brute_force(rows):
    texts = {}
    for corpus, document, text in rows:
        texts.setdefault((corpus, document), []).extend((text or "").split())
    num_docs = Counter(c for c, _ in texts)
    frequency = Counter((c, w) for (c, _), words in texts.items() for w in set(words))
    result = {}
    for (corpus, document), words in texts.items():
        for word, n in Counter(words).items():
            tf = math.log(n / len(words) + 1)
            icf = math.log((num_docs[corpus] + 1) / (frequency[corpus, word] + 1))
            result[corpus, document, word] = tf * icf
    return result


def as_dict(scores):
    rows = scores.collect()
    found = {(r.corpus, r.document, r.word): r.score for r in rows}
    assert len(found) == len(rows)
    return found


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        assert found[key] == pytest.approx(value, abs=1e-14)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("whole", [True, False])
def test_equals_brute_force(corpus, seed, whole):
    rows = random_rows(seed)
    assert_same(as_dict(term_weights(corpus(rows), "raw", whole)), brute_force(rows))


def test_documents_in_pieces(corpus):
    rows = random_rows(7)
    pieces = [(c, d, part) for c, d, text in rows for part in (text.split(" ", 3) or [""])]
    assert_same(as_dict(term_weights(corpus(pieces))), brute_force(rows))


@pytest.mark.parametrize("pieces", [1, 3, 20, 10**6])
@pytest.mark.parametrize("whole", [True, False])
def test_any_split_of_heavy_and_light_keys(corpus, pieces, whole):
    """The result does not depend on which keys are heavy: none, some, or all."""
    rows = random_rows(11, hot=True)
    assert_same(as_dict(term_weights(corpus(rows), "raw", whole, pieces=pieces)), brute_force(rows))


@pytest.mark.parametrize("length", [7, 200])
def test_a_heavy_key_of_any_length_is_split_evenly(spark, length):
    """Nine tenths of all rows carry one key; no task gets much more than its share of the rows."""
    hot = F.when(F.col("id") % 10 > 0, F.lit("x" * length)).otherwise(F.concat(F.lit("d"), F.col("id") % 500))
    rows = spark.range(100_000).select(hot.alias("document"), F.col("id").cast("string").alias("word"))
    sizes = rows.groupBy("document").agg(F.count(F.lit(1)).alias("n"))
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = lookup.lookup_join(rows, sizes, ["document"], sizes, "n")
        parts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(parts) == 100_000 and len(parts) == 16
    assert max(parts) < 2 * 100_000 / 16


def test_keys_that_share_a_hash_share_their_salts(spark, monkeypatch):
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("key"), "id")
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    monkeypatch.setattr(lookup.F, "xxhash64", lambda *c: F.crc32(F.lit("same")).cast("bigint"))
    joined = lookup.lookup_join(rows, table, ["key"], table, "n", 50)
    assert sorted(map(tuple, joined.collect())) == sorted((str(i % 7), i, 1000 // 7 + (i % 7 < 1000 % 7)) for i in range(1000))


def test_one_document_and_one_corpus_hold_most_rows(corpus):
    rows = [("big", "hot", "the the a" + f" w{i}") for i in range(300)]
    rows += [("big", f"d{i}", "the b") for i in range(20)] + [("small", "hot", "the x")]
    assert_same(as_dict(term_weights(corpus(rows))), brute_force(rows))


def test_counts_add_up(corpus):
    rows = random_rows(3)
    documents = corpus(rows)
    parts, frequency = term_counts(documents)
    parts, frequency = parts.collect(), frequency.collect()
    sizes = {r.corpus: r.num_docs for r in op.corpus_size(documents).collect()}
    by_document = {}
    for r in parts:
        by_document.setdefault((r.corpus, r.document), []).append(r)
    for group in by_document.values():
        assert sum(r.word_count for r in group) == group[0].doc_size
        assert sum(r.word_count / r.doc_size for r in group) == pytest.approx(1)
    assert all(1 <= r.num_docs_with_word <= sizes[r.corpus] for r in frequency)
    words = op.vocabulary(op.tokens(documents)).collect()
    assert sorted(words) == sorted((r.corpus, r.word) for r in frequency)


def test_score_is_zero_only_for_words_of_all_documents(corpus):
    rows = random_rows(5)
    documents = corpus(rows)
    parts, frequency = term_counts(documents)
    joined = op.icf_parts(parts, frequency, op.corpus_size(documents))
    for r in op.scores(joined).join(joined, ["corpus", "document", "word"]).collect():
        assert r.score >= 0
        assert (r.score == 0) == (r.num_docs_with_word == r.num_docs)


def test_one_document_scores_zero(corpus):
    assert set(as_dict(term_weights(corpus([("c", "d", "a b a")]))).values()) == {0.0}


def test_adding_a_corpus_leaves_the_others_alone(corpus):
    rows = random_rows(9)
    alone = [r for r in rows if r[0] == "c1"]
    together = as_dict(term_weights(corpus(rows)))
    assert as_dict(term_weights(corpus(alone))) == {k: v for k, v in together.items() if k[0] == "c1"}


def test_union_form_equals_join_form(corpus):
    documents = corpus(random_rows(13))
    tf, frequency = term_counts(documents)
    icf = op.icf_parts(tf, frequency, op.corpus_size(documents))
    assert as_dict(op.scores_by_union(tf, icf)) == as_dict(op.scores(icf))


@pytest.mark.parametrize("form", ["text", "parquet"])
def test_staged_equals_in_memory(corpus, tmp_path, form):
    documents = corpus(random_rows(17))
    staged = term_weights_staged(documents, str(tmp_path), form=form)
    assert as_dict(staged) == as_dict(term_weights(documents))


def test_null_text_counts_as_document(corpus):
    documents = corpus([("c", "d1", "a"), ("c", "d2", None)])
    assert [tuple(r) for r in op.corpus_size(documents).collect()] == [("c", 2)]
    assert as_dict(term_weights(documents)) == {
        ("c", "d1", "a"): pytest.approx(math.log(2) * math.log(3 / 2))
    }


@pytest.mark.parametrize(("name", "row"), [("document", ("c", None, "a")), ("corpus", (None, "d3", "a"))])
def test_rows_without_a_name_fail(corpus, name, row):
    documents = corpus([("c", "d1", "a"), row])
    for query in (op.corpus_size(documents), op.token_count(op.tokens(documents)), term_weights(documents)):
        with pytest.raises(Exception, match=f"has no {name}"):
            query.collect()


AWKWARD_NAMES = ["", "@", "@x", "__HIVE_DEFAULT_PARTITION__", "a/b", "a=b %41", "007", "é"]


@pytest.mark.parametrize("form", ["text", "parquet"])
def test_staged_equals_in_memory_for_any_corpus_name(corpus, tmp_path, form):
    documents = corpus([(c, f"d {i}", f"a b w{i}") for c in AWKWARD_NAMES for i in range(3)])
    staged = term_weights_staged(documents, str(tmp_path), form=form)
    assert as_dict(staged) == as_dict(term_weights(documents))


def test_staged_documents_of_any_name(corpus, tmp_path):
    documents = corpus([("c", d, f"a {i}") for i, d in enumerate(["u@x.org", "d\t1", "a\nb", "", "@"])])
    staged = term_weights_staged(documents, str(tmp_path / "table"))
    assert as_dict(staged) == as_dict(term_weights(documents))
    for name in ("u@x.org", "d\t1", "a\nb", "a\rb", "@"):
        with pytest.raises(Exception, match="cannot hold the document name"):
            term_weights_staged(corpus([("c", name, "a")]), str(tmp_path / "text"), form="text")


@pytest.mark.parametrize("sizes", [True, False])
def test_broken_promise_fails(corpus, sizes):
    documents = corpus([("c", "d", "a b"), ("c", "d", "a c")])
    given = op.corpus_size(documents) if sizes else None
    with pytest.raises(Exception, match="several rows"):
        term_weights(documents, "raw", one_row_per_document=True, sizes=given).collect()


def test_empty_corpus(corpus):
    assert term_weights(corpus([])).collect() == []
    assert term_weights(corpus([("c", "d", "")])).collect() == []


@pytest.mark.parametrize("profile", ["raw", "raw_java", "clean"])
def test_words_counted_in_their_row(corpus, profile):
    """The same counts as by grouping, for texts of any form."""
    texts = ["", " ", "a", "a a a", "b a b a", "A b\tC\na", " x", "é é e", None, "w " * 500, "\x01 \x02 a@b"]
    documents = corpus([(f"c{i % 2}", f"d{i}", t) for i, t in enumerate(texts)])
    sized = op.sized_word_count(op.sized_tokens(documents, profile))
    own = op.row_counts(documents, profile).select(*sized.columns)
    assert sorted(own.collect()) == sorted(sized.collect())


def test_slices_add_up(spark, corpus, tmp_path):
    """Slices that are counted apart give what the whole gives; adding one counts only its documents."""
    rows = random_rows(11)
    names = sorted({(c, d) for c, d, _ in rows})
    part = {name: i % 3 for i, name in enumerate(names)}
    paths = [str(tmp_path / f"slice-{i}") for i in range(3)]
    for i, path in enumerate(paths):
        write_slice(corpus([r for r in rows if part[r[:2]] == i]), path)
    for n in (1, 2, 3):
        whole = corpus([r for r in rows if part[r[:2]] < n])
        frequency = op.document_frequency(op.word_count(op.tokens(whole)))
        assert sorted(merged_frequency(spark, paths[:n]).collect()) == sorted(frequency.collect())
        assert sorted(merged_size(spark, paths[:n]).collect()) == sorted(op.corpus_size(whole).collect())
        weighted = merged_weights(spark, paths[:n])
        assert_same(as_dict(weighted), as_dict(term_weights(whole)))


def test_a_document_in_two_slices_fails(spark, corpus, tmp_path):
    paths = [str(tmp_path / name) for name in ("one", "two")]
    for path in paths:
        write_slice(corpus([("c", "same", "a b"), ("c", path, "x")]), path)
    for merged in (merged_documents, merged_frequency, merged_size, merged_weights):
        with pytest.raises(Exception, match="several slices have the document same"):
            merged(spark, paths).collect()


def test_empty_slices(spark, corpus, tmp_path):
    paths = [str(tmp_path / name) for name in ("none", "blank")]
    write_slice(corpus([]), paths[0])
    write_slice(corpus([("c", "d", None), ("c", "e", " ")]), paths[1])
    assert merged_frequency(spark, paths).collect() == []
    assert [tuple(r) for r in merged_size(spark, paths).collect()] == [("c", 2)]
    assert merged_weights(spark, paths).collect() == []
