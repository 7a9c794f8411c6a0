"""Structured Streaming twins of the merge, delivery and lifecycle folds."""
