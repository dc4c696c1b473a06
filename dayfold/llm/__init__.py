"""Operators for preparing language-model training text, one module each.

Nothing outside this subpackage imports it, except `corpus_pipeline.py` and the guarded registration.
"""
