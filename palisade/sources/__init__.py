"""Readers, parsers and writers, and engine tables derived from stored ones."""
