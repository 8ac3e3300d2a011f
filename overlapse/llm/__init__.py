"""Operators for preparing training data: clusters, set overlaps, distinct counts, packing,
evaluation leaks and text quality.  Nothing outside this folder imports it."""
