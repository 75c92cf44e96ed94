"""``python -m lexiweight INPUT... OUTPUT``: weigh the words of directories of text files.

Every input is a corpus, named by its last path segment, with a file for each document. The output
folder gets the sorted report of each corpus. Run it with ``spark-submit`` on a cluster. Lists of files
are written to ``spark.checkpoint.dir``, or next to the output where that is not set.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lexiweight import term_weights
from lexiweight.functions import PROFILES
from lexiweight.sinks import write_sorted_report
from lexiweight.sources import directory_size, scan_lines, union_corpora


def weigh(spark: SparkSession, inputs: list[str], output: str, profile: str, style: str) -> None:
    named = [(path, path.rstrip("/").rsplit("/", 1)[-1]) for path in inputs]
    if len({name for _, name in named}) < len(named):
        raise ValueError("inputs must have different last path segments")
    corpus = union_corpora(*(scan_lines(spark, path, name) for path, name in named))
    sizes = reduce(DataFrame.unionByName, [directory_size(spark, path, name) for path, name in named])
    write_sorted_report(term_weights(corpus, profile, sizes=sizes), output, style)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexiweight", description=__doc__)
    parser.add_argument("inputs", nargs="+", metavar="INPUT", help="directory, file or glob of text files")
    parser.add_argument("output", metavar="OUTPUT", help="folder of the reports; replaced")
    parser.add_argument("--profile", choices=PROFILES, default="raw")
    parser.add_argument("--style", choices=("shortest", "fixed"), default="shortest", help="form of the scores")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lexiweight").getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{given.output.rstrip('/')}-work")
    weigh(spark, given.inputs, given.output, given.profile, given.style)


if __name__ == "__main__":
    main()
