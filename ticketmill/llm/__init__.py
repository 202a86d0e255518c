"""Operators for training data over a table of documents, and their queries."""
