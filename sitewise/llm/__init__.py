"""Operators for preparing large text corpora for language-model training.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it is present.
"""
