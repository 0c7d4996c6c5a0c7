"""Firm-panel statistics on Spark DataFrames."""
