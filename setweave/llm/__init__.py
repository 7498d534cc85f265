"""Operators for preparing language-model data. Nothing else in the library imports this package."""
