"""Relational operators over fact, node and edge tables."""
