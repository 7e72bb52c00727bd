"""Operators for large text corpora and vector tables. Nothing else in the library imports this subpackage."""
