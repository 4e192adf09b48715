"""Operators on texts for language-model training.

Nothing outside this subpackage imports it.
"""
