"""The pipeline: every stage on its own input, and the registered queries."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{data_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, data_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_all_but_the_last_stage_return_documents(stages):
    for docs, result in stages[:-1]:
        assert result.columns == docs.columns and result.dtypes == docs.dtypes
        assert 0 < result.count()


def test_filters_only_remove(stages):
    for docs, result in stages[:2]:
        assert result.exceptAll(docs).isEmpty() and result.count() < docs.count()


def test_rejected_documents_are_the_bad_ones(spark, data_dir, stages):
    labels = spark.read.parquet(f"{data_dir}/labels.parquet")
    kept = stages[0][1].join(labels, "doc_id")
    rejected = stages[0][0].join(stages[0][1], "doc_id", "left_anti").join(labels, "doc_id")
    assert rejected.filter("quality = 1").isEmpty()
    assert rejected.count() > 2 * kept.filter("quality = 0").count()


def test_no_copies_are_left(stages):
    result = stages[1][1].withColumn("words", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    assert result.groupBy("words").count().filter("count > 1 and words <> ''").isEmpty()


def test_no_passage_is_left_twice(stages):
    docs, result = stages[2]
    assert result.count() == docs.count()
    shorter = docs.join(result.select("doc_id", F.col("text").alias("left")), "doc_id").filter(F.length("left") < F.length("text"))
    assert shorter.filter(F.length("left") > 0).count() > 0
    assert result.filter(F.col("n_chars") != F.length("text")).isEmpty()
    words = result.select("doc_id", "text").collect()
    whole = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text) for r in docs.select("doc_id", "text").collect()}
    first = {}
    for doc, w in sorted(whole.items()):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc)
    for r in words:
        w, gone = whole[r.doc_id], set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < r.doc_id:
                gone |= set(range(i, i + 13))
        assert [x for i, x in enumerate(w) if i not in gone] == re.findall(r"[^\x20\x09-\x0D]+", r.text)


def test_texts_without_repeats_stay_byte_for_byte(spark, data_dir):
    passage = " ".join(f"p{i}" for i in range(14))
    code = "def f(x):\n\treturn  x\r\n"
    rows = [(1, code), (2, f"{passage}\n\n a"), (3, f" x\t y\n{passage}\n\nb  c\n"), (4, passage), (None, f"  {passage}  "), (5, None), (6, " \n"), (2, f"é  {passage}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.length("text").cast("bigint"))
    left = corpus_pipeline.substring_dedup(spark, docs, data_dir).collect()
    expected = [(1, code), (2, rows[1][1]), (3, " x\t y\nb  c\n"), (4, ""), (None, rows[4][1]), (5, None), (6, " \n"), (2, rows[7][1])]
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted(expected, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_every_stage(spark, data_dir, tmp_path, empty):
    """Rows without ids, without texts, with long texts, repeated ones, and columns of clashing names."""
    prose = [r.text for r in spark.read.parquet(f"{data_dir}/documents.parquet").limit(12).collect()]
    rows = [(i, t, "en", "src1") for i, t in enumerate(prose)] * 2
    rows += [(None, t, None, None) for t in (prose[0], "", None)] + [(50, None, "en", "src2"), (51, "", "", ""), (52, " \n ", "en", "src3")]
    rows += [(53, "long " * 100_000, "en", "src4"), (54, "x" * 1_000_000, "en", "other")]
    docs = spark.createDataFrame([] if empty else rows, "doc_id bigint, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    docs = docs.withColumns({c: F.lit(f"clash {c}") for c in ("row", "score", "kept", "n_removed", "class_id", "copy", "keys", "tokens", "place")})
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data_dir).write.parquet(f"{tmp_path}/{i}")
        result = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == docs.columns, name
            clash = [c for c in docs.columns if c in ("row", "score", "kept", "n_removed", "class_id", "keys", "tokens", "place")]
            assert result.filter(" or ".join(f"`{c}` <> 'clash {c}'" for c in clash)).isEmpty(), name
            docs = result
    assert result.count() == docs.count() and (docs.count() > 0) != empty


def test_mixed_rows_are_copies_of_documents(stages):
    docs, result = stages[3]
    assert result.distinct().exceptAll(docs.distinct()).isEmpty()
    assert result.count() > result.select("doc_id").distinct().count()


def test_every_row_is_encoded(stages):
    docs, result = stages[4]
    texts = docs.select("doc_id", F.sha2("text", 256).alias("decoded_sha256")).exceptAll(result.select("doc_id", "decoded_sha256"))
    assert texts.isEmpty() and result.count() == docs.count()
    assert result.filter(F.octet_length("tokens") != 4 * F.col("n_tokens")).isEmpty()


def test_run_is_all_stages(spark, data_dir, stages):
    assert queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, data_dir).exceptAll(stages[-1][1]).isEmpty()


NUMBERED = sorted(n for n in queries() if re.match(r"op\d+_", n))


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in NUMBERED) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(NUMBERED) & set(oracle_sql())))
def test_query_equals_sql(spark, data_dir, name):
    connection = duckdb.connect()
    for file in Path(data_dir).glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    ours = queries()[name](spark, data_dir).toArrow()
    theirs = connection.sql(oracle_sql()[name]).arrow().read_all()
    columns = sorted(ours.column_names)
    assert columns == sorted(theirs.column_names)
    rows = lambda t: sorted(map(str, zip(*(t.column(c).to_pylist() for c in columns), strict=True)))
    assert rows(ours) == rows(theirs) and ours.num_rows
