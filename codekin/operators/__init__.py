"""Operators as functions from DataFrames to DataFrames, and the queries that run them."""
