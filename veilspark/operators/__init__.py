"""Relational operators of the pseudonymisation pipeline, as functions from DataFrames to DataFrames."""
