from lexiweight.plans.pipeline import term_counts, term_weights, term_weights_staged
from lexiweight.plans.slices import merged_documents, merged_frequency, merged_size, merged_weights, write_slice

__all__ = [
    "merged_documents",
    "merged_frequency",
    "merged_size",
    "merged_weights",
    "term_counts",
    "term_weights",
    "term_weights_staged",
    "write_slice",
]
