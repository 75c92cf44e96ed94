"""Term weighting of document collections on Spark."""

from lexiweight.plans import term_counts, term_weights, term_weights_staged

__all__ = ["term_counts", "term_weights", "term_weights_staged"]
