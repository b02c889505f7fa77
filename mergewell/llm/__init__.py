"""Operators for preparing language-model training data. Nothing outside of this subpackage imports it."""
