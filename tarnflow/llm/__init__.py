"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it; the package works without it.
"""
