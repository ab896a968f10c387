"""Operators on version logs, vectors, graphs and access logs."""
