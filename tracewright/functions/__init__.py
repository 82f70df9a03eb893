"""Scalar functions and storage helpers."""
