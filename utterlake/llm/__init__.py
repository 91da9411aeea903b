"""Operators for preparing training data: text form, leakage, splitting, packing, mixing and page quality.

Nothing outside this subpackage imports it.
"""
