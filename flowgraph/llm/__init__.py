"""Operators of a training-data pipeline, each a Spark job over a table of documents.

Nothing else in the library imports this subpackage.
"""
