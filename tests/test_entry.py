"""Registered queries over tables of a few rows of their own."""

from __future__ import annotations

import math
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import queries  # noqa: E402
from lexiweight import operators as op  # noqa: E402
from lexiweight import sinks, sources, term_weights, term_weights_staged  # noqa: E402
from lexiweight.operators import lookup  # noqa: E402
from lexiweight.plans import merged_weights, write_slice  # noqa: E402


@pytest.fixture()
def tables(spark, tmp_path):
    """Make a folder with ``documents`` of (doc_id, text, lang, source) rows."""

    def make(rows):
        table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
        table.write.parquet(f"{tmp_path}/tables/documents.parquet")
        return f"{tmp_path}/tables"

    return make


@pytest.mark.parametrize("name", ["scan_documents", "scan_lines", "directory_size"])
def test_files_are_those_of_single_documents(spark, tables, name):
    """Documents of one language and with near ids have files of their own."""
    found = queries()[name](spark, tables([(1, "b a b", "en", "s"), (2, "a\nb", "en", "s"), (3, None, "en", "s")]))
    if name == "directory_size":
        assert [tuple(r) for r in found.collect()] == [("files", 3)]
    else:
        expected = [("files", "1", "a", 1), ("files", "1", "b", 2), ("files", "2", "a", 1), ("files", "2", "b", 1)]
        assert sorted(tuple(r) for r in found.select("corpus", "document", "word", "word_count").collect()) == expected


def test_lookup_of_a_table_beyond_the_bound_of_a_broadcast(spark, tables):
    """The table of words has over 64 MiB as text; one word is in all documents."""
    rows = [(i, f"common {'w' * 1_400_000}{i}", "en", "s") for i in range(50)]
    found = queries()["icf_lookup"](spark, tables(rows))
    words = found.selectExpr("document", "length(word) > 6 as long", "num_docs", "num_docs_with_word").collect()
    assert sorted(tuple(r) for r in words) == sorted((str(i), long, 50, 1 if long else 50) for i in range(50) for long in (False, True))


@pytest.fixture()
def corpus_of_rows(corpus):
    """Two corpora; each document has a row of its own and one more that repeats a word."""
    rows = [(f"c{i % 2}", f"d{i}", f"common w{i % 7} w{i % 3} w{i % 3}") for i in range(40)]
    return corpus(rows + [(c, d, "common more") for c, d, _ in rows])


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_salts_of_many_pieces_are_bounded(spark):
    """A table of a row for each key and salt must not be as long as the rows."""
    rows = spark.range(5000).selectExpr("'c' as corpus", "'w' as word", "id")
    assert op.spread(rows, ["corpus", "word"], 40_000).select("salt").distinct().count() <= lookup.MOST_SALTS


def test_words_of_documents_of_many_rows_are_shuffled_once_by_document(corpus_of_rows):
    plan = planned(term_weights(corpus_of_rows, "clean"))
    assert not re.search(r"Exchange hashpartitioning\(corpus#\d+, document#\d+, word#", plan)
    found = {(r.corpus, r.document, r.word): (r.tf, r.icf) for r in term_weights(corpus_of_rows, "clean").collect()}
    assert len(found) == 40 * 2 + sum(len({i % 7, i % 3}) for i in range(40))
    tf, icf = found["c0", "d0", "common"]
    assert tf == pytest.approx(math.log(2 / 6 + 1)) and icf == 0
    assert found["c1", "d1", "w1"][0] == pytest.approx(math.log(3 / 6 + 1))


def test_merging_slices_shuffles_no_words_by_document(spark, corpus_of_rows, tmp_path):
    for i in range(2):
        write_slice(corpus_of_rows.filter(f"corpus = 'c{i}'"), f"{tmp_path}/{i}", "clean")
    merged = merged_weights(spark, [f"{tmp_path}/0", f"{tmp_path}/1"])
    by_document = re.findall(r"Exchange hashpartitioning\(corpus#\d+, document#\d+, salt", planned(merged))
    assert not by_document
    assert sorted(merged.collect()) == sorted(term_weights(corpus_of_rows, "clean").collect())


def test_union_shuffles_pairs_by_word_alone(corpus_of_rows):
    tf = op.tf_parts(op.word_count(op.tokens(corpus_of_rows, "clean")))
    scores = op.scores_by_union(tf, op.icf_parts(tf, None, op.corpus_size(corpus_of_rows)))
    union = planned(scores).split("Union")[0]
    assert "Exchange hashpartitioning(" not in union
    expected = term_weights(corpus_of_rows, "clean").select("corpus", "document", "word", "score").collect()
    found = {tuple(r)[:3]: r.score for r in scores.collect()}
    assert found == pytest.approx({tuple(r)[:3]: r.score for r in expected})


def test_report_lines_are_numbered_where_they_are_read(spark, corpus_of_rows, tmp_path):
    for compression in ("none", "lz4"):
        path = f"{tmp_path}/{compression}"
        sinks.write_sorted_report(term_weights(corpus_of_rows, "clean"), path, compression=compression)
        report = sources.scan_report(spark, path)
        assert "BroadcastHashJoin" in planned(report) and "SortMergeJoin" not in planned(report)
        for name in ("c0", "c1"):
            lines = sorted(report.filter(f"corpus = '{name}'").collect(), key=lambda r: r.rank)
            assert [r.rank for r in lines] == list(range(1, len(lines) + 1))
            assert [r.key for r in lines] == sorted(r.key for r in lines)


def counts_of(corpus_of_rows):
    """Words, occurrences and sizes of all documents, counted here."""
    words = {}
    for r in corpus_of_rows.collect():
        words.setdefault((r.corpus, r.document), []).extend((r.text or "").split())
    return sorted((*k, w, own.count(w), len(own)) for k, own in words.items() for w in set(own))


def test_tf_parts_shuffles_pairs_once(spark, tables, corpus_of_rows):
    """The counts lie where the sizes of documents come to them; documents of many rows are added up."""
    rows = [(i, f"common w{i % 7} w{i % 3} w{i % 3}", f"c{i % 2}", "s") for i in range(40)]
    plan = planned(queries()["tf_parts"](spark, tables(rows + rows[:5])))
    assert not re.search(r"Exchange hashpartitioning\(corpus#\d+, document#\d+, word#", plan)
    assert len(set(re.findall(r"Exchange hashpartitioning\(.*REPARTITION_BY_COL, \[plan_id=(\d+)", plan))) <= 2
    for pieces in (None, 1, 1000):
        combined = op.word_count(op.tokens(corpus_of_rows, "clean", combined=True), pieces)
        plain = op.word_count(op.tokens(corpus_of_rows, "clean"))
        assert sorted(combined.select(*plain.columns).collect()) == sorted(plain.collect())
        assert sorted(tuple(r) for r in op.tf_parts(combined).collect()) == counts_of(corpus_of_rows)


def test_icf_parts_shuffles_pairs_once(spark, tables, corpus_of_rows):
    """The counts are added up where the frequencies of words come to them; documents may have many rows."""
    rows = [(i, f"common w{i % 7} w{i % 3} w{i % 3}", f"c{i % 2}", "s") for i in range(40)]
    found = queries()["icf_parts"](spark, tables(rows + rows[:5]))
    found.toArrow()
    plan = planned(found).split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan
    assert not re.search(r"Exchange hashpartitioning\(corpus#\d+, document#\d+, word#", plan)
    assert len(set(re.findall(r"Exchange hashpartitioning\(corpus#\d+, word#\d+, salt#\d+, .*REPARTITION_BY_COL, \[plan_id=(\d+)", plan))) == 1
    sizes = op.corpus_size(corpus_of_rows)
    expected = op.icf_parts(op.word_count(op.tokens(corpus_of_rows, "clean")), None, sizes)
    for pieces in (None, 1, 1000):
        counts = op.word_count(op.tokens(corpus_of_rows, "clean", combined=True), pieces, "word")
        found = op.icf_parts(counts, None, sizes, pieces).select(*expected.columns)
        assert sorted(found.collect()) == sorted(expected.collect())


@pytest.mark.parametrize("slots", [1, 3, 1 << 17])
def test_staged_pairs_of_one_row_documents_stay_where_they_are_counted(spark, corpus, tmp_path, monkeypatch, slots):
    """Documents of one row are not shuffled to be counted; those of several are found, whatever shares their slot."""
    monkeypatch.setattr(sys.modules["lexiweight.operators.tokens"], "SLOTS", slots)
    single = [("c", f"d{i}", f"common w{i % 7} w{i % 7}") for i in range(30)] + [("c", "none", None), ("e", "d1", " ")]
    several = [("c", "many", "common w1"), ("c", "many", "w1"), ("e", "d0", "a"), ("e", "d0", "a"), ("e", "d0", None)]
    for rows in (single, several, single + several):
        documents, path = corpus(rows), f"{tmp_path}/{len(rows)}"
        expected = term_weights(documents, "clean").select("corpus", "document", "word", "score").collect()
        assert sorted(term_weights_staged(documents, path, "clean").collect()) == sorted(expected)
        names = {}
        for part in ("whole", "others"):
            stage = spark.read.schema("corpus string, document string").parquet(f"{path}/word_count/{part}")
            names[part] = {tuple(r) for r in stage.collect()}
        assert not names["whole"] & {("c", "many"), ("e", "d0")} and not names["whole"] & names["others"]
        if rows is single:
            assert len(names["whole"]) == 30 and not names["others"]
        assert spark.read.parquet(f"{path}/slots").count() <= slots
    assert "Exchange hashpartitioning" not in planned(op.row_counts(op.by_rows(documents, spark.read.parquet(f"{path}/slots"))[0], "clean"))
