"""Operators of a training-data pipeline: filtering, deduplication, mixing and tokenization of documents.

Nothing else in the package imports this subpackage; ``catalog`` registers its queries.
"""
