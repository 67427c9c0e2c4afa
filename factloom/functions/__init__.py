"""Scalar functions: glob patterns and names."""
