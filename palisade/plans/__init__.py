"""Queries of the dashboard, retrieval and evaluation, as DataFrame plans."""
