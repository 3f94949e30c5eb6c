"""Operators for preparing language-model training data.

Every module here stands on its own; nothing outside this subpackage imports it.
"""
