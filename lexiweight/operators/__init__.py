from lexiweight.operators.counts import (
    corpus_size,
    document_frequency,
    document_size,
    rekey,
    sized_word_count,
    token_count,
    vocabulary,
    word_count,
)
from lexiweight.operators.lookup import broadcast_lookup, frequent_lookup, join_spread, key_table, lookup_join, spread, spread_join
from lexiweight.operators.tokens import by_rows, keyed, row_counts, sized_tokens, slots_of_many_rows, tokens, whole_documents
from lexiweight.operators.weights import (
    frequency_table,
    icf_parts,
    scores,
    scores_by_union,
    size_table,
    tf_parts,
    word_table,
)

__all__ = [
    "broadcast_lookup",
    "by_rows",
    "corpus_size",
    "document_frequency",
    "document_size",
    "frequency_table",
    "frequent_lookup",
    "icf_parts",
    "join_spread",
    "key_table",
    "keyed",
    "lookup_join",
    "rekey",
    "row_counts",
    "scores",
    "scores_by_union",
    "size_table",
    "sized_tokens",
    "sized_word_count",
    "slots_of_many_rows",
    "spread",
    "spread_join",
    "tf_parts",
    "token_count",
    "tokens",
    "vocabulary",
    "whole_documents",
    "word_count",
    "word_table",
]
