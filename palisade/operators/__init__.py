"""Joins, rankings, merges and mutations between engine tables."""
