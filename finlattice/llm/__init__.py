"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; the folder, its tests and
``corpus_pipeline.py`` can be removed together.
"""
