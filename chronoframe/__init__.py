"""Versioned-document analytics on Spark DataFrames."""
