"""Scalar expressions, as columns."""
