"""Operators of a training-data pipeline: search, quality, privacy, near-duplicates, mixing, packing, output files.

Nothing else in the package imports this subpackage.
"""
