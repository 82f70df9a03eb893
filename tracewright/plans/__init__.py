"""Whole jobs: indexing, evaluation, benchmark, and the operators over plain tables."""
