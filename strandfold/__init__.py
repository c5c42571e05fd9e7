"""Partial-overlap deduplication of sequences, as functions from DataFrames to DataFrames."""
