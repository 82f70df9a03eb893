"""Incremental indexing of a stream of file snapshots."""
