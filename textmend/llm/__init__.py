"""Operators for preparing training data, on DataFrames of documents, pages and conversations."""
