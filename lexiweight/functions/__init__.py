from lexiweight.functions.text import (
    PROFILES,
    blank_nonalpha_start,
    document_id,
    make_key,
    pack_ratio,
    split_key_first,
    split_key_last,
    split_whitespace,
    strip_punctuation,
    trim_token,
    unpack_ratio,
    words,
)
from lexiweight.functions.weights import format_score, icf_weight, score_weight, tf_weight

__all__ = [
    "PROFILES",
    "blank_nonalpha_start",
    "document_id",
    "format_score",
    "icf_weight",
    "make_key",
    "pack_ratio",
    "score_weight",
    "split_key_first",
    "split_key_last",
    "split_whitespace",
    "strip_punctuation",
    "tf_weight",
    "trim_token",
    "unpack_ratio",
    "words",
]
