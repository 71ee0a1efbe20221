"""Operators for building language-model training data from a document corpus.

Nothing else in the package imports this subpackage; it may be deleted whole.
"""
