"""Operators for large training-data pipelines (quality, dedup, decontamination, mixing).

Nothing else in the library imports this subpackage.
"""
