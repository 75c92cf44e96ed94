"""

The main corpus table is ``documents``: corpus = ``lang``, document = ``doc_id``. Scores are
rounded to 12 places here, and only here, because the two engines' logarithms differ in the last
bit.
"""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable
from functools import wraps

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweight import operators as op
from lexiweight import sinks, sources, term_counts, term_weights, term_weights_staged
from lexiweight.functions import document_id, format_score, icf_weight, tf_weight
from lexiweight.plans import merged_frequency, merged_size, merged_weights, write_slice
from lexiweight.storage import new_folder

SMOKE_DIR = "/root/testdata/sf0.001"
# What is put around the texts of the odd documents, in turn.
ODD_ENDS = ["", " ", "\t\n", "\x01", " \x1f ", "7\u2028x", "1\u0085"]
# Compression of the text that queries write and read back.
TEXT_FILES = "lz4"
# Pieces into which the queries named large split all pairs: as on a cluster with many partitions.
MANY_PIECES = 40_000


# --- corpora ---------------------------------------------------------------------------------


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, corpus: DataFrame) -> DataFrame:
    """The corpus over as many partitions as the caller asks for by a setting; as it is read, if none.

    Files that are too few for the cores of a machine are worth it; others are not.
    """
    partitions = spark.conf.get("spark.lexiweight.repartition", None)
    return corpus.repartition(int(partitions)) if partitions else corpus


def _documents(spark: SparkSession, sf_dir: str, corpus: str = "lang") -> DataFrame:
    table = _table(spark, sf_dir, "documents")
    return _dealt(spark, sources.from_table(table, "doc_id", "text", corpus))


def _odd_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with what the profiles treat differently put before and into the texts: white
    space, control characters and line separators, by the number of the document."""
    table = _table(spark, sf_dir, "documents")
    ends = F.array(*(F.lit(e) for e in ODD_ENDS))
    end = F.get(ends, F.pmod("doc_id", F.lit(len(ODD_ENDS))).cast("int"))
    inner = F.replace(F.coalesce("text", F.lit("")), F.lit(" th"), F.lit(" 1a\u2028th"))
    text = F.concat(end, inner, end)
    return _dealt(spark, sources.from_table(table, "doc_id", text, "lang"))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per conversation, one row per turn."""
    table = _table(spark, sf_dir, "conversations")
    return sources.from_table(table, "conv_id", "text", F.lit("conversations"))


def _three_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    benchmark = _table(spark, sf_dir, "benchmark")
    return _dealt(
        spark,
        sources.union_corpora(
            sources.from_table(documents, "doc_id", "text", F.lit("documents")),
            sources.from_table(benchmark, "item_id", "text", F.lit("benchmark")),
            _conversations(spark, sf_dir),
        ),
    )


def _with_folder(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session that has a folder for tables. A cluster must name one that it shares; a
    single machine that names none gets a temporary one."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        local = context.master == "local" or context.master.startswith("local[")
        if local and not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiweight-"))
        return query(spark, sf_dir)

    return run


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 12) for n in names})


# --- queries ---------------------------------------------------------------------------------


def _counts(spark: SparkSession, sf_dir: str, profile: str = "clean") -> DataFrame:
    return op.word_count(op.tokens(_documents(spark, sf_dir), profile))


def _tf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.tf_parts(op.word_count(op.tokens(_documents(spark, sf_dir), "clean", combined=True)))


def _tf_parts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = op.whole_documents(_documents(spark, sf_dir))
    return term_counts(documents, "clean", one_row_per_document=True)[0]


def _icf_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    counts = op.word_count(op.tokens(documents, "clean", combined=True), key="word")
    parts = op.icf_parts(counts, None, op.corpus_size(documents))
    return parts.select("corpus", "document", "word", "num_docs", "num_docs_with_word")


def _tf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = tf_weight(F.col("word_count"), F.col("doc_size")).alias("tf")
    weights = _tf_parts_whole(spark, sf_dir).select("corpus", "document", "word", weight)
    return _rounded(weights, "tf")


def _icf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    frequency = op.document_frequency(op.word_count(op.tokens(documents, "clean")))
    table = op.word_table(frequency, op.corpus_size(documents))
    weight = icf_weight(F.col("num_docs"), F.col("num_docs_with_word")).alias("icf")
    return _rounded(table.select("corpus", "word", weight), "icf")


def _term_weights(
    spark: SparkSession, sf_dir: str, profile: str, corpus: str = "lang", **options: bool
) -> DataFrame:
    weighted = term_weights(_documents(spark, sf_dir, corpus), profile, **options)
    return _rounded(weighted, "tf", "icf", "score")


def _term_weights_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    tf, _ = term_counts(documents, "clean", one_row_per_document=True)
    icf = op.icf_parts(tf, None, op.corpus_size(documents, one_row_per_document=True))
    return _rounded(op.scores_by_union(tf, icf), "score")


def _multi_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = term_weights(_three_corpora(spark, sf_dir), "clean")
    return _rounded(weighted, "tf", "icf", "score")


def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = term_weights(_documents(spark, sf_dir), "clean", one_row_per_document=True)
    return _rounded(sinks.report_lines(weighted), "score")


def _sorted_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stages")
    weighted = term_weights(_documents(spark, sf_dir), "clean", one_row_per_document=True)
    sinks.write_sorted_report(weighted, path, compression=TEXT_FILES)
    back = sources.scan_stage(spark, path, "scores")
    return _rounded(sinks.report_lines(back), "score")


def _report_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the sorted report, with their numbers in the order of its files."""
    path = new_folder(spark, "stages")
    weighted = term_weights(_documents(spark, sf_dir), "clean", one_row_per_document=True)
    sinks.write_sorted_report(weighted, path, compression=TEXT_FILES)
    return sources.scan_report(spark, path).select("corpus", "rank", "key")


def _slices(spark: SparkSession, sf_dir: str) -> list[str]:
    """The documents counted in three slices by their sources, one after the other."""
    table = _table(spark, sf_dir, "documents")
    paths = []
    for i in range(3):
        own = table.filter(F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(3)) == i)
        paths.append(new_folder(spark, f"slice-{i}"))
        write_slice(_dealt(spark, sources.from_table(own, "doc_id", "text", "lang")), paths[-1], "clean")
    return paths


def _icf_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of most rows sent to the counts, within the bound of a broadcast; the rest by a shuffle."""
    documents = _documents(spark, sf_dir)
    counts = op.word_count(op.tokens(documents, "clean"))
    table = op.word_table(op.document_frequency(counts), op.corpus_size(documents))
    return op.frequent_lookup(counts, table, ["corpus", "word"], "num_docs_with_word").drop("word_count")


def _stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stages")
    sinks.write_stage(_counts(spark, sf_dir), "word_count", f"{path}/word_count", TEXT_FILES)
    counts = sources.scan_stage(spark, f"{path}/word_count", "word_count")
    sinks.write_stage(op.tf_parts(counts), "tf_parts", f"{path}/tf_parts", TEXT_FILES)
    return sources.scan_stage(spark, f"{path}/tf_parts", "tf_parts")


def _term_weights_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = term_weights_staged(_documents(spark, sf_dir), new_folder(spark, "stages"), "clean")
    return _rounded(staged, "score")


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """The texts of ``documents``, each in a file below a folder that names its document."""
    path = new_folder(spark, "texts")
    sinks.write_documents(_documents(spark, sf_dir), path)
    return path


def _named_by_folder(path: Column) -> Column:
    return F.regexp_extract(path, "/document=([^/]+)/", 1)


def _scanned(spark: SparkSession, sf_dir: str, scan: Callable[..., DataFrame]) -> DataFrame:
    corpus = scan(spark, _text_files(spark, sf_dir), "files", _named_by_folder)
    return op.word_count(op.tokens(corpus, "raw"))


def _directory_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.directory_size(spark, _text_files(spark, sf_dir), "files", _named_by_folder)


def _icf_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "stages")
    sinks.write_stage(_icf_parts(spark, sf_dir), "icf_parts", path, TEXT_FILES)
    return sources.scan_stage(spark, path, "icf_parts")


def _tf_weights_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights with 16 decimals, rounded as everywhere here; below 1, so that both engines print
    the same digits."""
    weights = _tf_weights(spark, sf_dir)
    return weights.withColumn("tf", format_score(F.col("tf"), "fixed"))


def _key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(document_id(F.col("url")).alias("document"))
    return pages.groupBy("document").agg(F.count(F.lit(1)).alias("num_pages"))


def _training_data() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the training-data operators; none where those are not installed."""
    names = {"corpus_pipeline", "lexiweight.llm"}
    try:
        import corpus_pipeline
        from lexiweight.llm import queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in names:
            raise
        return {}, {}
    return llm.queries() | {"pipeline": corpus_pipeline.run}, llm.oracle_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {
        "corpus_size": lambda s, d: op.corpus_size(_documents(s, d)),
        "token_count_raw": lambda s, d: op.token_count(op.tokens(_documents(s, d), "raw")),
        "token_count_raw_java": lambda s, d: op.token_count(op.tokens(_documents(s, d), "raw_java")),
        "token_count_clean": lambda s, d: op.token_count(op.tokens(_documents(s, d), "clean")),
        "word_count_raw": lambda s, d: _counts(s, d, "raw"),
        "word_count_raw_java": lambda s, d: _counts(s, d, "raw_java"),
        "word_count_clean": lambda s, d: _counts(s, d, "clean"),
        "document_size": lambda s, d: op.document_size(_counts(s, d)),
        "vocabulary": lambda s, d: op.vocabulary(op.tokens(_documents(s, d), "clean")),
        "document_frequency": lambda s, d: op.document_frequency(_counts(s, d)),
        "rekey_by_word": lambda s, d: op.rekey(_counts(s, d), "word"),
        "rekey_by_document": lambda s, d: op.rekey(_counts(s, d), "document"),
        "tf_parts": _tf_parts,
        "tf_parts_whole": _tf_parts_whole,
        "icf_parts": _icf_parts,
        "tf_weights": _tf_weights,
        "icf_weights": _icf_weights,
        "term_weights_raw": lambda s, d: _term_weights(s, d, "raw", one_row_per_document=True),
        "term_weights_clean": lambda s, d: _term_weights(s, d, "clean", one_row_per_document=True),
        "term_weights_pieces": lambda s, d: _term_weights(s, d, "clean"),
        # The same plans with keys split as finely as many partitions would ask for.
        "term_weights_large": lambda s, d: _term_weights(
            s, d, "clean", one_row_per_document=True, pieces=MANY_PIECES
        ),
        "term_weights_pieces_large": lambda s, d: _term_weights(s, d, "clean", pieces=MANY_PIECES),
        "term_weights_by_source": lambda s, d: _term_weights(s, d, "clean", corpus="source"),
        "term_weights_union": _term_weights_union,
        "term_weights_staged": _term_weights_staged,
        "multi_corpus": _multi_corpus,
        "document_frequency_merged": lambda s, d: merged_frequency(s, _slices(s, d)),
        "corpus_size_merged": lambda s, d: merged_size(s, _slices(s, d)),
        "term_weights_merged": lambda s, d: _rounded(merged_weights(s, _slices(s, d)), "tf", "icf", "score"),
        "icf_lookup": _icf_lookup,
        "report_rank": _report_rank,
        "report_lines": _report_lines,
        "sorted_report": _sorted_report,
        "stage_roundtrip": _stage_roundtrip,
        "tf_weights_fixed": _tf_weights_fixed,
        "icf_stage_roundtrip": _icf_stage,
        "scan_documents": lambda s, d: _scanned(s, d, sources.scan_documents),
        "scan_lines": lambda s, d: _scanned(s, d, sources.scan_lines),
        "directory_size": _directory_size,
        "token_count_raw_java_odd": lambda s, d: op.token_count(op.tokens(_odd_documents(s, d), "raw_java")),
        "word_count_raw_java_odd": lambda s, d: op.word_count(op.tokens(_odd_documents(s, d), "raw_java")),
        "word_count_clean_odd": lambda s, d: op.word_count(op.tokens(_odd_documents(s, d), "clean")),
        "key_parts": _key_parts,
    }
    return _training_data()[0] | {name: _with_folder(query) for name, query in own.items()}


def entry(spark: SparkSession) -> DataFrame:
    return queries()["term_weights_clean"](spark, SMOKE_DIR)


# --- the same in SQL -------------------------------------------------------------------------

_SPLIT = r"regexp_split_to_array({text}, '[ \t\n\x0B\f\r]+')"
_PUNCTUATION = r"""'[,.({}*=?!)''";:&]'"""
# The dot of the rule stops at line separators.
_NOT_A_TO_Z = r"^[^a-z]+[^\n\r\x{85}\x{2028}\x{2029}]*"
_DOCUMENTS = "select {corpus} as corpus, cast(doc_id as varchar) as document, text from documents"
_ODD = f"""
    select corpus, document, concat(ends, replace(coalesce(text, ''), ' th', concat(' 1a', chr(8232), 'th')), ends) as text
    from (select lang as corpus, cast(doc_id as varchar) as document, text,
        [{", ".join("concat('', " + ", ".join(f"chr({ord(c)})" for c in e) + ")" if e else "''" for e in ODD_ENDS)}][doc_id % {len(ODD_ENDS)} + 1] as ends
        from documents)"""
_THREE_CORPORA = """
    select 'documents' as corpus, cast(doc_id as varchar) as document, text from documents
    union all
    select 'benchmark', cast(item_id as varchar), text from benchmark
    union all
    select 'conversations', cast(conv_id as varchar), text from conversations"""


def _with(profile: str = "clean", corpus_sql: str | None = None) -> str:
    """Common table expressions: corpus, tokens, word counts, document sizes, frequencies, sizes."""
    if profile == "raw":
        tokens = f"""
            select corpus, document, word from (
                select corpus, document, unnest({_SPLIT.format(text="text")}) as word from corpora)
            where word <> ''"""
    elif profile == "raw_java":
        body = r"regexp_replace(text, '[ \t\n\x0B\f\r]+$', '')"
        tokens = rf"""
            select corpus, document,
                regexp_replace(piece, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') as word
            from (select corpus, document, unnest({_SPLIT.format(text=body)}) as piece
                from corpora where text = '' or {body} <> '')"""
    else:
        tokens = f"""
            select corpus, document, word from (
                select corpus, document,
                    regexp_replace(regexp_replace(piece, {_PUNCTUATION}, '', 'g'), '{_NOT_A_TO_Z}', '') as word
                from (select corpus, document, unnest({_SPLIT.format(text="lower(text)")}) as piece from corpora))
            where word <> ''"""
    return f"""
        with corpora as ({corpus_sql or _DOCUMENTS.format(corpus="lang")}),
        tokens as ({tokens}),
        counts as (
            select corpus, document, word, count(*) as word_count
            from tokens group by corpus, document, word),
        doc_sizes as (
            select corpus, document, cast(sum(word_count) as bigint) as doc_size
            from counts group by corpus, document),
        frequencies as (
            select corpus, word, count(*) as num_docs_with_word from counts group by corpus, word),
        sizes as (
            select corpus, count(distinct document) as num_docs from corpora group by corpus),
        weights as (
            select corpus, document, word,
                ln(word_count / doc_size + 1) as tf,
                ln((num_docs + 1) / (num_docs_with_word + 1)) as icf
            from counts join doc_sizes using (corpus, document)
                join frequencies using (corpus, word) join sizes using (corpus))
        """


_WEIGHTS = (
    "select corpus, document, word, round(tf, 12) as tf, round(icf, 12) as icf,"
    " round(tf * icf, 12) as score from weights"
)
_SCORES = "select corpus, document, word, round(tf * icf, 12) as score from weights"
_LINES = "select corpus, concat(document, '@', word) as key, round(tf * icf, 12) as score from weights"
_TF_PARTS = (
    "select corpus, document, word, word_count, doc_size"
    " from counts join doc_sizes using (corpus, document)"
)
_ICF_PARTS = (
    "select corpus, document, word, num_docs, num_docs_with_word"
    " from counts join frequencies using (corpus, word) join sizes using (corpus)"
)
_TOKEN_COUNT = "select corpus, document, count(*) as num_tokens from tokens group by corpus, document"
_FILES = "select 'files' as corpus, cast(doc_id as varchar) as document, text from documents"
_COUNTS = "select corpus, document, word, word_count from counts"


def _rekey_sql(key: str) -> str:
    return (
        f"select corpus, {key}, count(*) as num_pairs, cast(sum(word_count) as bigint) as num_tokens"
        f" from counts group by corpus, {key}"
    )


def oracle_sql() -> dict[str, str]:
    clean, raw, raw_java = _with("clean"), _with("raw"), _with("raw_java")
    return _training_data()[1] | {
        "corpus_size": clean + "select corpus, num_docs from sizes",
        "token_count_raw": raw + _TOKEN_COUNT,
        "token_count_raw_java": raw_java + _TOKEN_COUNT,
        "token_count_clean": clean + _TOKEN_COUNT,
        "word_count_raw": raw + "select corpus, document, word, word_count from counts",
        "word_count_raw_java": raw_java + "select corpus, document, word, word_count from counts",
        "word_count_clean": clean + "select corpus, document, word, word_count from counts",
        "document_size": clean + "select corpus, document, doc_size from doc_sizes",
        "vocabulary": clean + "select distinct corpus, word from tokens",
        "document_frequency": clean + "select corpus, word, num_docs_with_word from frequencies",
        "rekey_by_word": clean + _rekey_sql("word"),
        "rekey_by_document": clean + _rekey_sql("document"),
        "tf_parts": clean + _TF_PARTS,
        "tf_parts_whole": clean + _TF_PARTS,
        "icf_parts": clean + _ICF_PARTS,
        "tf_weights": clean + "select corpus, document, word, round(tf, 12) as tf from weights",
        "icf_weights": clean
        + "select corpus, word, round(ln((num_docs + 1) / (num_docs_with_word + 1)), 12) as icf"
        " from frequencies join sizes using (corpus)",
        "term_weights_raw": raw + _WEIGHTS,
        "term_weights_clean": clean + _WEIGHTS,
        "term_weights_pieces": clean + _WEIGHTS,
        "term_weights_large": clean + _WEIGHTS,
        "term_weights_pieces_large": clean + _WEIGHTS,
        "term_weights_by_source": _with("clean", _DOCUMENTS.format(corpus="source")) + _WEIGHTS,
        "term_weights_union": clean + _SCORES,
        "term_weights_staged": clean + _SCORES,
        "multi_corpus": _with("clean", _THREE_CORPORA) + _WEIGHTS,
        "document_frequency_merged": clean + "select corpus, word, num_docs_with_word from frequencies",
        "corpus_size_merged": clean + "select corpus, num_docs from sizes",
        "term_weights_merged": clean + _WEIGHTS,
        "icf_lookup": clean + _ICF_PARTS,
        "report_rank": clean + "select corpus, row_number() over (partition by corpus order by key) as rank, key"
        " from (select corpus, concat(document, '@', word) as key from weights)",
        "report_lines": clean + _LINES,
        "sorted_report": clean + _LINES,
        "stage_roundtrip": clean + _TF_PARTS,
        "tf_weights_fixed": clean
        + "select corpus, document, word, printf('%.16f', round(tf, 12)) as tf from weights",
        "icf_stage_roundtrip": clean + _ICF_PARTS,
        "scan_documents": _with("raw", _FILES) + _COUNTS,
        "scan_lines": _with("raw", _FILES) + _COUNTS,
        "directory_size": _with("raw", _FILES) + "select corpus, num_docs from sizes",
        "token_count_raw_java_odd": _with("raw_java", _ODD) + _TOKEN_COUNT,
        "word_count_raw_java_odd": _with("raw_java", _ODD) + _COUNTS,
        "word_count_clean_odd": _with("clean", _ODD) + _COUNTS,
        "key_parts": "select split(url, '/')[-1] as document, count(*) as num_pages"
        " from pages group by 1",
    }
