"""Scalar functions: spans, flags, identifiers, paths."""
