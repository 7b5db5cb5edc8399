"""Ranking and qualification analytics on Spark DataFrames."""
