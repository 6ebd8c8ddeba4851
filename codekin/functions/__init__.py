"""Scalar functions as Spark columns; pandas UDFs only where Spark has no expression."""
