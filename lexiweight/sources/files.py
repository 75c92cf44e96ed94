"""Corpora from text files, one file per document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweight.functions.text import document_id
from lexiweight.sources.listing import list_files, roots
from lexiweight.storage import new_folder

# Tasks for each core in which Spark's file index lists folders, and in which small files are read at least.
TASKS_PER_CORE = 4
# Files of a task at most, if Spark puts fewer into a partition.
FILES_OF_TASK = 256
# Files whose names the driver holds at once.
FILES_AT_ONCE = 1 << 16
# Characters of a name that would make it a glob.
_GLOB = re.compile(r"[{}\[\]*?\\]")
_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"

# Turns the path of a file into the id of its document.
Naming = Callable[[Column], Column]


def _decoded(path: Column) -> Column:
    """A path of file metadata as ``list_files`` has it. It is URL-encoded there, but for the plus sign,
    which stands for itself; local paths start with one slash or with three."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/(?=[^/])", "file:///")


@contextmanager
def _listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Spark's file index lists many folders in a few tasks for each core, not in 10,000."""
    before = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(before), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING_TASKS, before)


def _bytes(setting: str) -> int:
    """The value of a setting such as ``128m``, ``256MB`` or ``134217728b``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * (" kmgtp".index(unit) if unit else 0)


def _tasks(spark: SparkSession, number: int, length: int) -> int:
    """Tasks that read files: one for so many bytes, or names, as a task should have, and some for each core."""
    most = max(1, _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return max(-(-length // most), -(-number // FILES_OF_TASK), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def _texts(spark: SparkSession, path: str | list[str], **options: bool) -> DataFrame:
    with _listed_in_few_tasks(spark):
        rows = spark.read.text(path, recursiveFileLookup=True, **options)
    return rows.select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))


def _read(spark: SparkSession, path: str, files: DataFrame | None = None, **options: bool) -> DataFrame:
    """``(path, text)`` from Spark's text source, over the files that ``list_files`` lists too.

    It counts every file as some more megabytes and so deals small files out a few to a partition, far
    more partitions than their bytes are worth. With the listing ``files`` these are put together.

    Its index holds all names on the driver. So files beyond ``FILES_AT_ONCE`` are read as many at a time
    when this function is called, and what they hold is written to the shared folder; each time the driver
    has the names of that part only.
    """
    if files is None:
        return _texts(spark, path, **options)
    number, length = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if number <= FILES_AT_ONCE:
        return _texts(spark, path, **options).coalesce(_tasks(spark, number, length))
    copy, parts = new_folder(spark, "contents"), -(-number // FILES_AT_ONCE)
    dealt = files.select("path", F.pmod(F.xxhash64("path"), F.lit(parts)).alias("part"))
    for part in range(parts):
        names = [_GLOB.sub(r"\\\g<0>", r.path) for r in dealt.filter(F.col("part") == part).toLocalIterator()]
        rows = _texts(spark, names, **options).coalesce(_tasks(spark, len(names), -(-length // parts)))
        rows.write.mode("append").option("compression", "zstd").parquet(copy)
    return spark.read.schema("path string, text string").parquet(copy)


def _named(rows: DataFrame, corpus: str, naming: Naming) -> DataFrame:
    return rows.select(F.lit(corpus).alias("corpus"), naming(F.col("path")).alias("document"), "text")


def scan_documents(spark: SparkSession, path: str, corpus: str, naming: Naming = document_id) -> DataFrame:
    """``(corpus, document, text)``, one row per file below a folder, at any depth, or of a file or glob.

    Files are read by Spark's text source, as many to a partition as ``spark.sql.files.maxPartitionBytes``
    holds, or more if that makes very many partitions. It drops empty files, which would falsify the number
    of documents; these come from the listing (see ``list_files``), which is made when this function is
    called; more than ``FILES_AT_ONCE`` files are read then, too. A single file must fit in a row (2 GB); use
    ``scan_lines`` for larger ones.

    ``naming`` makes the document id of the path. By default it is the base name, so files of one
    name in several directories are pieces of one document; pass ``lambda path: path`` to keep them
    apart.
    """
    files = list_files(spark, path)
    empty = files.filter("length = 0").select("path", F.lit("").alias("text"))
    return _named(_read(spark, path, files, wholetext=True).unionByName(empty), corpus, naming)


def scan_lines(spark: SparkSession, path: str, corpus: str, naming: Naming = document_id) -> DataFrame:
    """``(corpus, document, text)``, one row per line; large files are read in parallel.

    A file without a line yields no row: pass ``directory_size`` to the pipeline if there may be
    empty files. Paths and ``naming`` are those of ``scan_documents``. Local files are listed when this
    function is called, to read small ones in fewer tasks, and read if they are more than ``FILES_AT_ONCE``.
    """
    local = all(root.startswith("file://") for root, _ in roots(spark, path))
    return _named(_read(spark, path, list_files(spark, path) if local else None), corpus, naming)


def directory_size(spark: SparkSession, path: str, corpus: str, naming: Naming = document_id) -> DataFrame:
    """``(corpus, num_docs)``: number of documents in the files of any path that the scans take.

    The files are listed and their names counted in jobs (see ``list_files``). The driver holds none of
    them, and no file is opened.
    """
    documents = list_files(spark, path).select(naming(F.col("path")).alias("document")).distinct()
    return documents.agg(F.count(F.lit(1)).alias("num_docs")).select(F.lit(corpus).alias("corpus"), "num_docs")
