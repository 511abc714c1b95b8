"""Operators for training-data pipelines (classifiers, deduplication, scans, tokens, archives).

Nothing else in the library imports this subpackage; it imports only general helpers of the library.
"""
