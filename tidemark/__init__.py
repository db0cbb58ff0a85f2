"""Tidemark: versioned-resource analytics on Spark DataFrames."""
