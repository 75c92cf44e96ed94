"""Encoding and decoding, against the tokenizers library on whole texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lexiweight.llm import bpe
from lexiweight.llm import words as W

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check(spark, library, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, tokens string")
    rows = bpe.encode_decode(docs, PATH, carry=["tokens"]).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(row.tokens, "<u4").tolist() == ids
        assert row.n_tokens == len(ids)
        assert row.decoded == library.decode(ids, skip_special_tokens=False)
        assert row.row.tokens == "x"


ODD = ["", None, " ", "\n", "  a", "a  ", "a  b", "  x", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "<|endoftext|", "!'s 'll''re don't 'q", "漢字 漢字", "é́", "😀😀", "\x00\x1f\x7f\x85", "qxz" * 3000, "a" * 100_000, "zq'jx'sq1q9"]


def test_odd_texts(spark, library):
    check(spark, library, ODD + ODD)


def test_random_texts(spark, library):
    rng = random.Random(1)
    letters = [*"abcXYZqjz019 '\"\n\t\r!?<|>.,-_", "é", "ß", " ", " ", "漢", "😀", "́", "'s", "'ll", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 127), rng.randint(0, 0x2FFF)])) for _ in range(30)) for _ in range(2000)]
    check(spark, library, texts)


def test_fragments_are_the_text_and_cuts_are_certain():
    cut = bpe.cut_table(open(PATH).read())
    inner = bpe.inner_pairs(open(PATH).read())
    assert not (cut & inner).any() and cut.any()
    (block,) = W.blocks(pa.array(["Some words, and more.", "", "x"]))
    found = bpe.fragments(block, cut)
    assert b"".join(block.data[a:b].tobytes() for a, b in zip(found.start, found.end, strict=True)) == block.data.tobytes()
    assert len(found.start) > 5
    for a in found.start[found.at > 0]:
        assert not inner[block.data[a - 1], block.data[a]]


def test_equal_hashes_of_different_fragments(monkeypatch):
    (block,) = W.blocks(pa.array(["aa bb aa", "bb c"]))
    found = bpe.fragments(block, ~np.zeros((256, 256), bool))
    monkeypatch.setattr(W, "word_hashes", lambda block, words: np.zeros(len(words.start), np.uint64))
    first, which = bpe.distinct(block, found)
    pieces = [block.data[a:b].tobytes() for a, b in zip(found.start, found.end, strict=True)]
    assert [pieces[first[w]] for w in which] == pieces


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        bpe.inner_pairs(open(public_tokenizers.path("word_bpe_49k.json")).read())


def test_empty_table(spark, library):
    check(spark, library, [])
