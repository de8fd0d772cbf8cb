"""Leak and personal-data scanning on Spark DataFrames."""
