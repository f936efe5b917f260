"""Operators for text corpora of training data, and their queries.

Nothing else in the library imports this subpackage.
"""
