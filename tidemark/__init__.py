"""Versioned time-series analytics on Spark DataFrames."""
