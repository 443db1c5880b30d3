"""Measurement and literature evidence analytics on Spark DataFrames."""
