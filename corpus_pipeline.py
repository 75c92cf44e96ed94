"""From raw documents to token ids: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but
the last return the columns of ``documents``, and any others that ``docs`` has, whatever their names.
An empty table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiweight.llm import quality
from lexiweight.llm.bpe import encode_decode
from lexiweight.llm.minhash import drop_near_duplicates
from lexiweight.llm.mixing import mix
from lexiweight.llm.queries import GOOD_FROM, SOURCE_WEIGHTS, tokenizer_path
from lexiweight.llm.shared import new_folder
from lexiweight.llm.substring import remove_repeats


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the corpus.

    Null, empty and blank texts score the mean of the labels. Repeated rows are all kept or all rejected.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.filter(F.col("score") >= GOOD_FROM).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies, the one with the smallest id.

    Rows without an id or without a word are kept. Rows that repeat id and text stay once.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text without the passages that a document of a smaller id has. Only their words are cut out,
    each with what separates it from the next; a text without such passages stays byte for byte.

    A null text stays null. A row without an id keeps its text and takes nothing from others.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    left = remove_repeats(docs, carry=[*others, "text"], whole=True)
    text = F.when(F.col("n_removed") == 0, F.col("row")["text"]).otherwise(F.col("kept"))
    values = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return left.select(*(values[c].alias(c) if c in values else F.col("row")[c].alias(c) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources that are left, in equal parts that add up to the bytes of ``docs``: a document
    appears as often as it was drawn, maybe never.

    Null, empty and unlisted sources are one group. Repeated rows are drawn equally often; null texts
    count no bytes.
    """
    return mix(docs, SOURCE_WEIGHTS, refill=True).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids as little-endian unsigned 32-bit integers, and a digest of the decoded text.

    A row for each row, repeated or not; a null text has no tokens.
    """
    coded = encode_decode(docs, tokenizer_path(), carry=["source"])
    return coded.select(
        "doc_id",
        F.col("row.source").alias("source"),
        "n_tokens",
        "tokens",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_filter),
    ("minhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mixing),
    ("bpe encoding", encoding),
]

# Models, samples and tokens are beyond SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each is written to the shared folder and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_folder(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
