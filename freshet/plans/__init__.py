"""Operators composed into the analysis from samples to published tables."""
