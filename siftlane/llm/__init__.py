"""Operators of a training-data pipeline: dedup, search, tokens, mixing, fingerprints, language and LM scores.

Nothing else in the package imports this subpackage.
"""
