"""Operators for text corpora and free entry. Nothing else in the library imports this subpackage."""
