"""Operators for preparing language-model training data, each with one registered query."""
