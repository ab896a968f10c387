"""Filters and queries that compile to DataFrame plans."""
