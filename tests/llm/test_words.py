"""Words, windows and fragments of texts as arrays."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from lexiweight.llm import words as W

TEXTS = ["", " ", "a", " a  bc\td\n", None, "é\x1cx y", "z" * 5000, "a b a b a b", "   x", "end "]


def python_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("limit", [1, 7, 1 << 20])
@pytest.mark.parametrize("rows", [1, 3, 1 << 14])
def test_words_of_blocks(limit, rows):
    found = [[] for _ in TEXTS]
    for block in W.blocks(pa.array(TEXTS), limit, rows):
        own = W.split(block)
        for a, b, doc, at in zip(own.start, own.end, own.doc, own.at, strict=True):
            assert at == len(found[block.rows[doc]])
            found[block.rows[doc]].append(block.data[a:b].tobytes().decode())
        assert own.count.tolist() == [len(found[r]) for r in block.rows]
    assert found == [python_words(t) for t in TEXTS]


def test_slices_of_a_column():
    column = pa.array(TEXTS).slice(2, 4)
    texts = [b.text(i).tobytes().decode() for b in W.blocks(column, 3) for i in range(len(b.rows))]
    assert texts == [t or "" for t in TEXTS[2:6]]
    assert list(W.blocks(pa.array([], pa.string()))) == []


def test_equal_windows_have_equal_hashes():
    text = "one two three four one two three five"
    (block,) = W.blocks(pa.array([text, "x " + text]))
    found = W.split(block)
    hashes = W.word_hashes(block, found)
    assert len(set(hashes.tolist())) == 6
    at = W.whole_windows(found, 3)
    keys = W.window_hashes(hashes, 3)[at]
    words = np.array(python_words(text) + ["x"] + python_words(text))
    grams = [" ".join(words[i : i + 3]) for i in at]
    assert len(set(keys.tolist())) == len(set(grams))
    assert len({(k, g) for k, g in zip(keys.tolist(), grams, strict=True)}) == len(set(grams))


def test_hashes_do_not_depend_on_the_block(monkeypatch):
    (block,) = W.blocks(pa.array(["aa bb ccc " * 50]))
    whole = W.word_hashes(block, W.split(block))
    monkeypatch.setattr(W, "BLOCK_BYTES", 5)
    assert (W.word_hashes(block, W.split(block)) == whole).all()
