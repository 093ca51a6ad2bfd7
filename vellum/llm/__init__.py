"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; ``queries`` registers the
operators and :mod:`corpus_pipeline` chains five of them.
"""
