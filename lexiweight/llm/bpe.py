"""Byte-level BPE encoding and decoding of whole texts (forced-boundary splitting)."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiweight.llm import words as W
from lexiweight.llm.shared import ship

# Fragments that a task remembers, and the longest of them; others are encoded each time.
MAX_REMEMBERED = 200_000
MAX_REMEMBERED_BYTES = 64


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the others for the rest in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def inner_pairs(tokenizer_json: str) -> np.ndarray:
    """256 x 256 flags: does any token hold the one byte followed by the other?"""
    tokenizer = json.loads(tokenizer_json)
    kinds = [tokenizer[k] and tokenizer[k]["type"] for k in ("model", "pre_tokenizer", "decoder")]
    if kinds != ["BPE", "ByteLevel", "ByteLevel"] or tokenizer["normalizer"] or tokenizer["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError("not a plain byte-level BPE tokenizer")
    letters = byte_of_letter()
    inner = np.zeros((256, 256), bool)
    tokens = [bytes(letters[c] for c in t) for t in tokenizer["model"]["vocab"] if all(c in letters for c in t)]
    tokens += [t["content"].encode() for t in tokenizer["added_tokens"]]
    for token in tokens:
        inner[list(token[:-1]), list(token[1:])] = True
    return inner


def cut_table(tokenizer_json: str) -> np.ndarray:
    """256 x 256 flags: is the boundary between the two bytes a certain cut?

    No merge crosses a pair of bytes that no token holds. The tokenizer splits a text by a
    pattern first, though, so a cut must not change that split either: the byte before it is
    printable ASCII, because the pattern looks ahead behind white space only, and the byte after
    it is no apostrophe, at which a fragment could start with a contraction.
    """
    cut = ~inner_pairs(tokenizer_json)
    before = np.zeros(256, bool)
    before[0x21:0x7F] = True
    cut &= before[:, None]
    cut[:, ord("'")] = False
    return cut


def fragments(block: W.Block, cut: np.ndarray) -> W.Words:
    """The pieces between certain cuts; together they are the whole texts."""
    n = len(block.data)
    begins = np.zeros(n, bool)
    if n:
        begins[1:] = cut[block.data[:-1], block.data[1:]]
        edges = block.offsets[:-1]
        begins[edges[edges < n]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n) if n else start
    doc = np.searchsorted(block.offsets, start, "right") - 1
    count = np.bincount(doc, minlength=len(block.rows)).astype(np.int64)
    return W.Words(start, end, doc, W.spans(count), count)


def distinct(block: W.Block, found: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first of each different fragment, and for every fragment which it equals."""
    keys = W.word_hashes(block, found)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    length = found.end - found.start
    same = length == length[first][which]
    same &= _equal_bytes(block.data, found.start, found.start[first][which], np.where(same, length, 0))
    if same.all():
        return first, which
    # Two fragments with one hash: tell them apart by their bytes.
    order: dict[bytes, int] = {}
    pieces = [block.data[a:b].tobytes() for a, b in zip(found.start, found.end, strict=True)]
    which = np.array([order.setdefault(p, len(order)) for p in pieces])
    return np.unique(which, return_index=True)[1], which


def _equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    equal = np.ones(len(a), bool)
    step = max(1, len(a) // 4 + 1)
    for i in range(0, len(a), step):
        own = slice(i, i + step)
        place, n = W.spans(length[own]), length[own]
        differs = data[np.repeat(a[own], n) + place] != data[np.repeat(b[own], n) + place]
        equal[i + np.repeat(np.arange(len(n)), n)[differs]] = False
    return equal


def token_bytes(tokenizer_json: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that each id decodes to, one after the other, and where each id's begin."""
    tokenizer = json.loads(tokenizer_json)
    letters = byte_of_letter()

    def decoded(token: str) -> bytes:
        """A token with any letter that stands for no byte decodes to its own text."""
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    by_id = {i: decoded(t) for t, i in tokenizer["model"]["vocab"].items()}
    by_id |= {t["id"]: decoded(t["content"]) for t in tokenizer["added_tokens"]}
    parts = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    offsets = np.cumsum([0, *(len(p) for p in parts)])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


class _Coder:
    """Encodes fragments with the tokenizers library, each different one once."""

    def __init__(self, tokenizer_json: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, for each piece."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > MAX_REMEMBERED:
            self.known, new = {}, pieces
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            found = self.tokenizer.encode_batch_fast([p.decode() for p in part], add_special_tokens=False)
            self.known.update(zip(part, (array("I", e.ids).tobytes() for e in found), strict=True))
        out = [self.known[p] for p in pieces]
        for piece in new:
            if len(piece) > MAX_REMEMBERED_BYTES:
                del self.known[piece]
        return out


def _joined(parts: list[bytes], which: np.ndarray, doc: np.ndarray, rows: int) -> list[bytes]:
    """For each row, the parts of its fragments one after the other."""
    flat = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(p) for p in parts], np.int64)
    return _gathered(flat, np.concatenate([[0], np.cumsum(length)]), which, np.bincount(doc, minlength=rows))


def _gathered(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray, per_row_parts: np.ndarray) -> list[bytes]:
    """For each row, its parts ``flat[offsets[i] : offsets[i + 1]]`` one after the other."""
    rows = len(per_row_parts)
    offset, length = offsets[:-1], np.diff(offsets)
    fragment_edges = np.concatenate([[0], np.cumsum(per_row_parts)])
    totals = np.concatenate([[0], np.cumsum(length[which])])[fragment_edges]
    per_row = np.diff(totals)
    out = []
    # A few rows at a time: the positions of all bytes take eight times their room.
    first = 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(np.cumsum(per_row[first:]), 1 << 20)) + first)
        own = which[fragment_edges[first] : fragment_edges[last]]
        n = length[own]
        data = flat[np.repeat(offset[own], n) + W.spans(n)].tobytes()
        edges = np.concatenate([[0], np.cumsum(per_row[first:last])]).tolist()
        out += [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        first = last
    return out


def _code(tokenizer_json, cut, decoding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = _Coder(tokenizer_json.value)
        for batch in batches:
            for block in W.blocks(batch.column("text")):
                found = fragments(block, cut.value)
                rows = len(block.rows)
                if len(found.start):
                    first, which = distinct(block, found)
                    starts, ends = found.start[first].tolist(), found.end[first].tolist()
                    raw = block.data.tobytes()
                    ids = coder([raw[a:b] for a, b in zip(starts, ends, strict=True)])
                    tokens = _joined(ids, which, found.doc, rows)
                    counts = np.array([len(t) // 4 for t in tokens])
                    decoded = _gathered(*decoding.value, np.frombuffer(b"".join(tokens), "<u4"), counts)
                else:
                    tokens, decoded = [b""] * rows, [b""] * rows
                same = [batch.column(c).slice(block.rows.start, rows) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays(
                    [
                        same[0],
                        pa.array([len(t) // 4 for t in tokens], pa.int64()),
                        pa.array(tokens, pa.binary()),
                        pa.array(decoded, pa.binary()).cast(pa.string()),
                        same[1],
                    ],
                    names=["doc_id", "n_tokens", "tokens", "decoded", "row"],
                )

    return run


def encode_decode(docs: DataFrame, tokenizer_path: str, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, n_tokens, tokens, decoded, row)``: token ids of each whole text, and back.

    ``tokens`` holds the ids as little-endian unsigned 32-bit integers, the same ids that the
    tokenizers library gives for the whole text without added special tokens, truncation or
    padding. ``decoded`` is the text that the library makes of them, special tokens included.
    ``row`` is a struct of the columns named in ``carry``, unchanged.

    Texts are cut where two bytes meet that no token of the vocabulary holds in this order (see
    ``cut_table``). The fragments are encoded one by one, each different one once for a block of
    texts, and put together again. A null or empty text has no tokens. Rows are independent of
    each other: repeated rows give repeated results, and columns that are not carried are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    ship(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("nothing"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), carried.alias("row"))
    result = T.StructType(
        [
            texts.schema["doc_id"],
            *T.StructType.fromDDL("n_tokens bigint, tokens binary, decoded string").fields,
            T.StructField("row", texts.schema["row"].dataType),
        ]
    )
    parts = (tokenizer_json, cut_table(tokenizer_json), token_bytes(tokenizer_json))
    code = _code(*(context.broadcast(p) for p in parts))
    return texts.mapInArrow(code, result)
