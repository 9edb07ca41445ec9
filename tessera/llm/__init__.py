"""Operators for preparing language-model training data.

Nothing outside this subpackage (and the pipeline file at the repository's
top) imports it.
"""
