"""Operators over the snapshot tables, as functions from DataFrames to DataFrames."""
