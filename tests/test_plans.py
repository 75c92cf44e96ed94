"""The plans Spark runs: what is shared, what is pruned, what is broadcast."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexiweight import operators as op
from lexiweight import sources, storage, term_weights
from lexiweight.operators import lookup
from lexiweight.plans import pipeline


@pytest.fixture()
def documents(spark, data_dir):
    table = spark.read.parquet(f"{data_dir}/documents.parquet")
    return sources.from_table(table, "doc_id", "text", "lang")


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles_of_words(df):
    """The distinct subtrees below the shuffles that split text, without expression ids."""
    lines = re.sub(r"#\d+L?|plan_id=\d+|[xy]_\d+", "", planned(df)).split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    found = set()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" not in line:
            continue
        below = []
        for other in lines[i + 1 :]:
            if depth(other) <= depth(line):
                break
            below.append(other.lstrip(" :+-*"))
        first_exchange = next((j for j, b in enumerate(below) if "Exchange" in b), len(below))
        own = below[:first_exchange]
        if any("Generate explode" in b and b.endswith(("[word]", "[pair]")) for b in own):
            found.add("\n".join([line.lstrip(" :+-*"), *own]))
    return found


@pytest.mark.parametrize("profile", ["raw", "clean"])
@pytest.mark.parametrize("whole", [True, False])
def test_text_is_split_once(documents, profile, whole):
    """All branches read one shuffle of the words: their subtrees are equal to the letter."""
    weighted = term_weights(documents, profile, whole)
    assert len(shuffles_of_words(weighted)) == 1
    assert len(shuffles_of_words(weighted.select("document", "word"))) == 1
    assert len(shuffles_of_words(weighted.select("document", "icf"))) == 1


@pytest.mark.parametrize("setting", ["128m", "256MB", "100000", "1g"])
def test_one_plan_for_every_size(spark, documents, setting):
    """The plan depends on no size estimate, and no setting with a unit breaks it."""
    shape = lambda df: re.sub(r"#\d+L?|plan_id=\d+|x_\d+", "", df._jdf.queryExecution().optimizedPlan().toString())
    expected = shape(term_weights(documents))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, setting)
        assert shape(term_weights(documents)) == expected
        many = documents.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("copy")
        assert term_weights(many)._jdf.queryExecution().executedPlan().toString().count("Join") == planned(term_weights(documents)).count("Join")
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def final_parts(df):
    """The final plan and those of its subqueries, without the initial ones."""
    parts = re.split(r"== (Initial|Final) Plan ==", planned(df))
    return [text for kind, text in zip(["Final", *parts[1::2]], parts[::2], strict=True) if kind == "Final"]


@pytest.mark.parametrize("whole", [True, False])
def test_text_is_split_once_at_run_time(documents, whole):
    weighted = term_weights(documents, "clean", whole)
    weighted.toArrow()
    final = "".join(final_parts(weighted))
    assert "isFinalPlan=true" in final and "isFinalPlan=false" not in final
    # Words counted in their row go straight to where frequencies are joined with them.
    keys = r"corpus#\d+, word#\d+, salt#\d+" if whole else r"corpus#\d+, document#\d+.*word#\d+"
    origin = "REPARTITION_BY_COL" if whole else "ENSURE_REQUIREMENTS"
    of_words = rf"Exchange hashpartitioning\({keys}, \d+\), {origin}, \[plan_id=(\d+)"
    assert len(set(re.findall(of_words, final))) == 1
    assert "Python" not in final


@pytest.mark.parametrize("profile", ["raw", "raw_java", "clean"])
def test_no_filter_splits_the_text_again(documents, profile):
    for plan in (op.tokens(documents, profile), op.sized_tokens(documents, profile)):
        text = planned(plan)
        assert text.count("split(") == 1, text


def test_word_count_combines_before_the_shuffle(documents):
    plan = planned(op.word_count(op.tokens(documents)))
    assert "partial_count" in plan.split("Exchange")[1]
    assert plan.count("Exchange") == 1


def test_columns_are_pruned(documents):
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in planned(op.corpus_size(documents))
    plan = planned(op.word_count(op.tokens(documents)))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    assert "IsNotNull" not in plan


def test_corpus_filter_reaches_the_scan(documents):
    plan = planned(op.word_count(op.tokens(documents.filter(F.col("corpus") == "en"))))
    assert "EqualTo(lang,en)" in plan


def test_only_the_salts_are_broadcast(spark):
    """One broadcast by hint on either side: the salts of heavy keys, two numbers for each. All
    else is up to Spark's size threshold."""
    rows = spark.range(1000).select((F.col("id") % 7).cast("string").alias("key"), "id")
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup.lookup_join(rows, table, ["key"], table, "n")
    logical = joined._jdf.queryExecution().analyzed().toString().split("\n")
    hinted = [i for i, line in enumerate(logical) if "ResolvedHint" in line]
    assert len(hinted) == 2
    assert all("broadcast" in logical[i] and "key_hash" in logical[i + 1] for i in hinted)


def test_salts_are_bounded(spark):
    """However the rows are spread, the salts beyond one for each key are fewer than the pieces."""
    for exponent in (0, 1, 3):
        weights = [i**exponent for i in range(1, 500)]
        for pieces in (5, 50):
            salts = [-(-w * pieces // sum(weights)) for w in weights]
            assert sum(s > 1 for s in salts) <= pieces and sum(s - 1 for s in salts) <= pieces


def test_a_corpus_with_most_words_is_split(spark):
    rows = spark.range(10_000).select(F.lit("c").alias("corpus"), F.col("id").cast("string").alias("word"), F.lit(1).alias("num_docs_with_word"))
    table = spark.createDataFrame([("c", 5)], "corpus string, num_docs bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = op.word_table(rows, table).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 10_000
    assert max(r["count"] for r in sizes) < 5_000


def splits(df):
    return len(re.findall(r"Generate explode.*\[(?:word|pair)#\d+\]", planned(df)))


def test_splits_without_shared_shuffles(spark, documents):
    """Even where Spark may not share shuffles. A join of the pairs with their own sums reads them twice, and
    the table of words, which is such a sum, is joined with the sizes of corpora in the same way."""
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert splits(term_weights(documents, "clean", True)) == 3
        assert splits(term_weights(documents, "clean", False)) == 6
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_stages_stay_in_their_buckets(spark, documents, tmp_path):
    """What is joined with a stage comes to its buckets; the pairs themselves are not shuffled."""

    def bucketed(table, name, keys):
        storage.write_buckets(table, f"{tmp_path}/{name}", keys)
        return storage.read_buckets(spark, f"{tmp_path}/{name}", table.schema, keys)

    counts = bucketed(pipeline.counts_by_document(documents, "clean"), "counts", pipeline.BY_DOCUMENT)
    parts = pipeline.parts_of_counts(counts)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        exchanged = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", planned(parts))
        names = [re.sub(r"#\d+", "", e) for e in exchanged]
        # The sums of each bucket by document, and their way back.
        assert sorted(names) == ["corpus, document", "corpus, document, salt"]
        assert planned(parts).count("Bucketed: true") == 2
        by_word = op.spread(parts, ["corpus", "word"], by=["document"])
        written = bucketed(by_word, "parts", pipeline.BY_WORD)
        scored = pipeline.scores_of_parts(written, op.corpus_size(documents))
        plan = planned(scored)
        pairs = [line for line in plan.split("\n") if "Exchange" in line and "document" in line and "word" in line]
        assert pairs == [] and "Bucketed: true" in plan
        assert scored.count() == term_weights(documents, "clean").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_leave_nothing_in_the_catalog(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").cast("string").alias("a b`c"), (F.col("id") % 3).alias("n"))
    before = len(spark.catalog.listTables())
    rows = rows.withColumnRenamed("a b`c", "name")
    for _ in range(2):  # the second run replaces the first
        storage.write_buckets(rows, f"{tmp_path}/it's", ["n"])
    back = storage.read_buckets(spark, f"{tmp_path}/it's", rows.schema, ["n"])
    assert sorted(back.collect()) == sorted(rows.collect())
    assert len(spark.catalog.listTables()) == before
    assert "Exchange" not in planned(back.groupBy("n").count())


def test_a_key_of_all_rows_is_spread(spark):
    """One word in 100,000 documents, and a document of 100,000 words, over all tasks."""
    words = spark.range(100_000).select(F.lit("c").alias("corpus"), F.col("id").cast("string").alias("document"), F.lit("w").alias("word"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows, keys in ((words, ["corpus", "word"]), (words.select("corpus", F.col("document").alias("word"), F.lit("d").alias("document")), ["corpus", "document"])):
            sizes = op.spread(rows, keys, 16).groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in sizes) == 100_000
            assert max(r["count"] for r in sizes) < 100_000 // 2 and len(sizes) >= 5
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("most", [10, 10_000])
def test_a_broadcast_beyond_its_bound_fails(spark, most):
    rows = spark.range(1000).select((F.col("id") % 100).cast("string").alias("key"), "id")
    table = spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit("value").alias("value"))
    joined = op.broadcast_lookup(rows, table, ["key"], most)
    if most == 10:
        with pytest.raises(Exception, match="690 bytes, more than 10"):
            joined.collect()
    else:
        assert joined.count() == 1000 and "BroadcastHashJoin" in planned(joined)
    empty = op.broadcast_lookup(rows, table.limit(0), ["key"], most)
    assert empty.count() == 0


def test_library_has_no_driver_side_work():
    package = Path(__file__).resolve().parents[1] / "lexiweight"
    own = [f for f in package.rglob("*.py") if "llm" not in f.parts]
    code = "\n".join(f.read_text() for f in own)
    for word in (".collect(", "toPandas", "coalesce(1)", "udf(", "mapInPandas", "localCheckpoint"):
        assert word not in code, word
