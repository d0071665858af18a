"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers its
queries only when it can be imported.
"""
