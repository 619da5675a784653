"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only when it is present.
"""
