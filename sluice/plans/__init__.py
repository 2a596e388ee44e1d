"""Whole queries over the test tables."""
