"""Splitting and cleaning, including the texts on which engines tend to differ."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiweight import functions as lf
from lexiweight import operators as op

CASES = [
    ("", [], [""], []),
    (" \n ", [], [], []),
    ("  a b \n", ["a", "b"], ["", "a", "b"], ["a", "b"]),
    ("a", ["a"], ["a"], ["a"]),
    ("a\x0bb\fc\rd", ["a", "b", "c", "d"], ["a", "b", "c", "d"], ["a", "b", "c", "d"]),
    ("a@b foo@ @", ["a@b", "foo@", "@"], ["a@b", "foo@", "@"], ["a@b", "foo@"]),
    (
        "Don't 2nd b-52 Été (x) [y]",
        ["Don't", "2nd", "b-52", "Été", "(x)", "[y]"],
        ["Don't", "2nd", "b-52", "Été", "(x)", "[y]"],
        ["dont", "b-52", "x"],
    ),
    ("1a\u2028def 1\u2029def \u0085x a\u20281b ~\u0085é", None, None, ["\u2028def", "a\u20281b"]),
    ("end] aquí 123 1a {z} ~q ... a/b", None, None, ["end]", "aquí", "z", "a/b"]),
    ("\x01a\x02 \x03", ["\x01a\x02", "\x03"], ["a", ""], []),
    (None, None, None, None),
]


@pytest.mark.parametrize("profile", [0, 1, 2])
def test_words(spark, profile):
    name = lf.PROFILES[profile]
    table = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, text string")
    found = {r.i: r.w for r in table.select("i", lf.words(F.col("text"), name).alias("w")).collect()}
    for i, case in enumerate(CASES):
        if case[0] is None or case[profile + 1] is not None:
            assert found[i] == case[profile + 1], (name, case[0])


@pytest.mark.parametrize("profile", lf.PROFILES)
def test_tokens_and_sizes_agree(corpus, profile):
    documents = corpus([("c", str(i), c[0]) for i, c in enumerate(CASES)])
    plain = op.word_count(op.tokens(documents, profile))
    sized = op.sized_word_count(op.sized_tokens(documents, profile))
    joined = op.tf_parts(plain)
    assert sorted(joined.collect()) == sorted(sized.collect())


def test_short_cleaner_equals_the_steps(spark):
    """Cleaning the text at once gives what cleaning every word by itself gives."""
    texts = [(c[0],) for c in CASES if c[0] is not None]
    table = spark.createDataFrame(texts, "text string")
    one_by_one = F.filter(
        F.transform(
            lf.split_whitespace(F.lower("text")),
            lambda w: F.regexp_replace(lf.strip_punctuation(w), "^[^a-z]+.*", ""),
        ),
        lambda w: (w != "") & ~w.rlike("^[0-9]+$"),
    )
    rows = table.select(one_by_one.alias("a"), lf.words(F.col("text"), "clean").alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_unknown_profile(spark):
    with pytest.raises(ValueError, match="unknown profile"):
        lf.words(F.lit("a"), "other")


def test_keys(spark):
    row = spark.range(1).select(
        lf.make_key(F.lit("a@b"), F.lit("doc")).alias("key"),
        *lf.split_key_last(F.lit("a@b@doc")),
        *lf.split_key_first(F.lit("doc@a@b")),
        lf.pack_ratio(F.lit(3), F.lit(7)),
        *lf.unpack_ratio(F.lit("3/7")),
        *lf.unpack_ratio(F.lit("x")),
        lf.document_id(F.lit("file:/a/b/c.txt")),
        lf.trim_token(F.lit("\x01 a b\t")),
    ).first()
    assert list(row) == ["a@b@doc", "a@b", "doc", "doc", "a@b", "3/7", 3, 7, None, None, "c.txt", "a b"]
