"""Reading directories of files and stages, writing stages."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiweight import operators as op
from lexiweight import sinks, sources, term_weights
from lexiweight.__main__ import weigh


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "one.txt").write_text("a b\na\n")
    (tmp_path / "two words+100%.txt").write_text("b c")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def test_scan_documents_keeps_empty_files(spark, folder):
    rows = {r.document: r.text for r in sources.scan_documents(spark, folder, "c").collect()}
    assert rows == {"one.txt": "a b\na\n", "two words+100%.txt": "b c", "empty.txt": ""}


def test_scan_documents_runs_in_the_jvm(spark, folder):
    plan = sources.scan_documents(spark, folder, "c")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_scan_lines(spark, folder):
    rows = sources.scan_lines(spark, folder, "c").collect()
    assert sorted((r.corpus, r.document, r.text) for r in rows) == [
        ("c", "one.txt", "a"),
        ("c", "one.txt", "a b"),
        ("c", "two words+100%.txt", "b c"),
    ]


def sizes_of(*args):
    return [tuple(r) for r in sources.directory_size(*args).collect()]


def test_directory_size_counts_empty_files(spark, folder):
    assert sizes_of(spark, folder, "c") == [("c", 3)]


@pytest.mark.parametrize("path", ["", "/*.txt", "/one.txt", "/{one,empty}.txt", "/two*"])
@pytest.mark.parametrize("setting", ["128m", "256MB", "4MB"])
def test_directory_size_of_any_path_that_the_scans_take(spark, folder, path, setting):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", setting)
    try:
        documents = sources.scan_documents(spark, folder + path, "c")
        assert sizes_of(spark, folder + path, "c") == [("c", documents.count())]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_driver_holds_no_list(spark, folder):
    """The names are in tables that jobs wrote; the plan has neither rows of its own nor a Python list,
    and no file of the corpus is opened."""
    plan = sources.directory_size(spark, folder, "c")._jdf.queryExecution().toString()
    assert "LocalRelation" not in plan and "RDD" not in plan and "LocalTableScan" not in plan
    assert folder not in plan and "listing-" in plan


def test_scans_use_no_gateway():
    code = Path(sources.files.__file__).read_text() + Path(sources.listing.__file__).read_text()
    assert "_jvm" not in code and "_jsc" not in code and "inputFiles" not in code


def test_every_level_of_folders(spark, tmp_path):
    """Folders at any depth, of partitions too; hidden ones are left out."""
    for name in ("part=0", "part=1", "a/b/c", "a", "_x=1", "_temporary/0", ".git", "a/.cache", "empty"):
        (tmp_path / name).mkdir(parents=True, exist_ok=True)
        (tmp_path / name / f"doc-{name.replace('/', '-')}").write_text("" if name == "a" else "a")
    (tmp_path / "empty" / "doc-empty").unlink()
    path = str(tmp_path)
    expected = {"doc-part=0", "doc-part=1", "doc-a-b-c", "doc-a", "doc-_x=1"}
    assert {r.document for r in sources.scan_documents(spark, path, "c").collect()} == expected
    assert {r.document for r in sources.scan_lines(spark, path, "c").collect()} == expected - {"doc-a"}
    assert sizes_of(spark, path, "c") == [("c", 5)]
    lengths = {r.path.rsplit("/", 1)[-1]: r.length for r in sources.list_files(spark, path).collect()}
    assert lengths == {n: int(n != "doc-a") for n in expected}


@pytest.mark.parametrize(
    "glob",
    ["*", "*/*", "?", "x/*", "{x,y}/doc[12]", "{x/doc1,y/doc*}", "*/doc[^1]", "x/doc[1-2]", "y/{doc1,doc2}", "*/doc\\*", "x", "{x,y,z}", "*/*/*", "*/a b%+.txt"],
)
def test_globs_find_what_spark_finds(spark, tmp_path, glob):
    for name in ("x/doc1", "x/doc2", "y/doc1", "y/doc3", "y/a b%+.txt", "y/doc*", "z/deep/doc4", "top.txt", "x/_SUCCESS", "z/.hidden"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}")
    path = f"{tmp_path}/{glob}"
    ours = sorted(r.path for r in sources.list_files(spark, path).collect())
    theirs = sorted(r.path for r in sources.files._read(spark, path).collect())
    assert ours == theirs and ours


def test_missing_paths_fail(spark, tmp_path):
    with pytest.raises(Exception, match="nothing-here"):
        sources.list_files(spark, f"{tmp_path}/nothing-here")
    with pytest.raises(ValueError, match="absolute"):
        sources.listing.rooted("relative", "hdfs://nn:8020")


def test_relative_paths_and_roots(spark, folder):
    relative = os.path.relpath(folder)
    assert sizes_of(spark, relative, "c") == sizes_of(spark, f"./{relative}/*", "c") == [("c", 3)]
    rooted = sources.listing.rooted
    assert rooted("/a/b*/c", "hdfs://nn:8020") == ("hdfs://nn:8020/a", ["b.*", "c"])
    assert rooted("s3://bucket/a b", "file:///") == ("s3://bucket/a b", [])
    assert rooted("file:/x/y", "hdfs://nn:8020") == ("file:///x/y", [])


def test_many_names_in_one_folder(spark, tmp_path):
    for i in range(20_000):
        (tmp_path / f"{i}").touch()
    assert sources.list_files(spark, f"{tmp_path}").count() == 20_000
    assert sizes_of(spark, str(tmp_path), "c") == [("c", 20_000)]


def test_partitions_follow_the_setting(spark, tmp_path):
    for i in range(64):
        (tmp_path / f"{i}").write_text("x" * 1000)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in zip(names, ("2000", "0"), strict=True):
            spark.conf.set(n, v)
        rows = sources.scan_documents(spark, str(tmp_path), "c").filter("text <> ''")
        assert rows.select(F.spark_partition_id()).distinct().count() == 64 // 2
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("scan", [sources.scan_documents, sources.scan_lines])
def test_files_beyond_those_whose_names_the_driver_holds(spark, folder, monkeypatch, scan):
    for name in ("a {b,c}.txt", "d[1]*?", "e\\f", "g,h"):
        (Path(folder) / name).write_text(f"text of {name}\nmore")
    whole = lambda p: p
    expected = sorted(scan(spark, folder, "c", whole).collect())
    held = []
    monkeypatch.setattr(sources.files, "FILES_AT_ONCE", 2, raising=False)
    texts = sources.files._texts
    monkeypatch.setattr(sources.files, "_texts", lambda s, p, **o: held.append(p) or texts(s, p, **o))
    assert sorted(scan(spark, folder, "c", whole).collect()) == expected
    assert len(held) > 2 and all(isinstance(p, list) for p in held)


def test_small_files_share_tasks(spark, tmp_path):
    """Spark puts 32 small files into a partition of 128 MB, as each counts 4 MB more."""
    for i in range(1200):
        (tmp_path / f"{i}").write_text("x")
    few = sources.files.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert sources.scan_lines(spark, str(tmp_path), "c").rdd.getNumPartitions() <= few


def test_written_documents(spark, corpus, tmp_path):
    """A file for each document, whatever its name, rows as lines; no rows are no files."""
    rows = [("c", "1", "a b"), ("c", "1", None), ("c", "x/y=%z", "é\n"), ("c", "", "s"), ("c", None, "t")]
    for number, part in ((3, rows), (0, [])):
        path = f"{tmp_path}/{number}"
        sinks.write_documents(corpus(part), path)
        found = {r.path.split("document=")[1]: sorted(r.text.split("\n")) for r in sources.files._read(spark, path, wholetext=True).collect()}
        names = {"1/text": ["", "", "a b"], "x%2Fy%3D%25z/text": ["", "", "é"], "__HIVE_DEFAULT_PARTITION__/text": ["", "s", "t"]}
        assert found == (names if number else {})
        assert sources.list_files(spark, path).count() == number


@pytest.mark.parametrize("scan", [sources.scan_documents, sources.scan_lines])
def test_equal_names_in_several_folders(spark, tmp_path, scan):
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "doc1").write_text(f"a {name}")
    path = f"{tmp_path}/*/*"
    assert {r.document for r in scan(spark, path, "c").collect()} == {"doc1"}
    assert sizes_of(spark, path, "c") == [("c", 1)]
    whole = lambda p: p
    assert len({r.document for r in scan(spark, path, "c", whole).collect()}) == 2
    assert sizes_of(spark, path, "c", whole) == [("c", 2)]


@pytest.mark.parametrize("whole", [True, False])
def test_lines_and_documents_agree(spark, folder, whole):
    documents = term_weights(sources.scan_documents(spark, folder, "c"), "raw", whole)
    size = sources.directory_size(spark, folder, "c")
    lines = term_weights(sources.scan_lines(spark, folder, "c"), "raw", sizes=size)
    assert sorted(documents.collect()) == sorted(lines.collect())
    assert documents.count() == 4


def test_from_table_and_union(spark):
    table = spark.createDataFrame([(1, "x y", "en"), (2, None, "de")], "id int, body string, lang string")
    union = sources.union_corpora(
        sources.from_table(table, "id", "body", "lang"),
        sources.from_table(table, F.col("id") + 1, F.upper("body"), F.lit("all")),
    )
    assert sorted(map(tuple, union.collect()), key=str) == sorted(
        [("en", "1", "x y"), ("de", "2", None), ("all", "2", "X Y"), ("all", "3", None)], key=str
    )


AWKWARD = [
    ("007", "d1", "a@b foo@ @ @@ x/y p=q 3/7 \"quoted 'single \\back é"),
    ("007", "d2", "a@b   x"),
    ("8", "d1", "a@b other"),
    ("8", "empty", ""),
]


@pytest.mark.parametrize("stage", sources.STAGES)
def test_stage_roundtrip(spark, corpus, tmp_path, stage):
    documents = corpus(AWKWARD)
    counts = op.word_count(op.tokens(documents))
    table = {
        "word_count": lambda: counts,
        "tf_parts": lambda: op.tf_parts(counts),
        "icf_parts": lambda: op.icf_parts(counts, op.document_frequency(counts), op.corpus_size(documents)).select("corpus", "document", "word", "num_docs", "num_docs_with_word"),
        "scores": lambda: term_weights(documents).drop("tf", "icf"),
    }[stage]()
    path = str(tmp_path / "stage")
    for _ in range(2):  # the second run replaces the first
        sinks.write_stage(table, stage, path)
    back = sources.scan_stage(spark, path, stage)
    assert back.columns == table.columns
    assert sorted(back.collect()) == sorted(table.collect())
    sinks.write_table(table, str(tmp_path / "table"))
    again = spark.read.schema(table.schema).parquet(str(tmp_path / "table")).select(*table.columns)
    assert sorted(again.collect()) == sorted(table.collect())


def test_report_is_sorted_by_the_whole_key(spark, corpus, tmp_path):
    documents = corpus(
        [("c", d, "b a Z é") for d in ("doc1", "doc1-x", "doc10", "doc2")] + [("d", "doc1", "y x")]
    )
    path = str(tmp_path / "report")
    sinks.write_sorted_report(term_weights(documents), path)
    for name, rows in (("c", 16), ("d", 2)):
        lines = []
        for part in sorted((tmp_path / "report" / f"corpus={name}").glob("part-*")):
            lines += part.read_bytes().splitlines()
        keys = [line.split(b"\t")[0] for line in lines]
        assert keys == sorted(keys) and len(keys) == rows
    assert any(k.startswith(b"doc1") for k in keys)


@pytest.mark.parametrize("split", [None, "300"])
def test_lines_of_a_report_are_numbered(spark, corpus, tmp_path, split):
    """The rank of a line is its place in the order of the keys' bytes, however its file is read."""
    rows = [(c, f"doc{d}", " ".join(f"{w}{d % 3}" for w in "b a Z é 0 zz".split())) for c, n in (("x", 40), ("007", 3), ("@", 1)) for d in range(n)]
    path = str(tmp_path / "report")
    sinks.write_sorted_report(term_weights(corpus(rows)), path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        if split:
            for n, v in zip(names, (split, "0"), strict=True):
                spark.conf.set(n, v)
        found = sources.scan_report(spark, path).collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    for name in ("x", "007", "@"):
        keys = sorted(f"{d}@{w}".encode() for c, d, text in rows if c == name for w in text.split())
        assert [(r.rank, r.key.encode()) for r in sorted(found, key=lambda r: r.rank) if r.corpus == name] == list(enumerate(keys, 1))
    assert all(r.score >= 0 for r in found)


def test_malformed_report_lines_fail(spark, tmp_path):
    (tmp_path / "corpus=c").mkdir()
    (tmp_path / "corpus=c" / "part-0").write_text("doc@word\tmany\n")
    with pytest.raises(Exception, match="not a line of this stage"):
        sources.scan_report(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("write", ["stage", "table"])
def test_number_of_files_follows_the_data(spark, corpus, tmp_path, write):
    rows = [(f"c{i % 50}", f"d{i}", f"w{i}") for i in range(2000)]
    counts = op.word_count(op.tokens(corpus(rows).repartition(4)))
    path = str(tmp_path / "out")
    sinks.write_stage(counts, "word_count", path) if write == "stage" else sinks.write_table(counts, path)
    files = list((tmp_path / "out").glob("corpus=*/part-*"))
    assert 50 <= len(files) <= 60


@pytest.mark.parametrize(
    ("stage", "line"),
    [("word_count", "foo\t3"), ("word_count", "a@d\tx"), ("word_count", "a@d"), ("word_count", "a@d\t1\t2"), ("word_count", ""), ("tf_parts", "a@d\t1/2/3"), ("tf_parts", "a@d\t1"), ("icf_parts", "a@d\t/2"), ("scores", "d@a\tone")],
)
def test_malformed_lines_fail(spark, tmp_path, stage, line):
    (tmp_path / "part").write_text(line + "\n")
    with pytest.raises(Exception, match="not a line of this stage"):
        sources.scan_stage(spark, str(tmp_path), stage, "c").collect()


def test_launcher(spark, tmp_path):
    for name, texts in (("songs", ["a b", "", "b"]), ("mails", ["x"])):
        (tmp_path / name).mkdir()
        for i, text in enumerate(texts):
            (tmp_path / name / f"d{i}").write_text(text)
    weigh(spark, [str(tmp_path / "songs"), str(tmp_path / "mails/")], str(tmp_path / "out"), "raw", "shortest")
    found = sources.scan_stage(spark, str(tmp_path / "out"), "scores").collect()
    rows = [(c, f"d{i}", t) for c, ts in (("songs", ["a b", "", "b"]), ("mails", ["x"])) for i, t in enumerate(ts)]
    expected = term_weights(spark.createDataFrame(rows, "corpus string, document string, text string"))
    assert sorted(found) == sorted(expected.drop("tf", "icf").collect())
    with pytest.raises(ValueError, match="different"):
        weigh(spark, ["a/x", "b/x"], "out", "raw", "shortest")
