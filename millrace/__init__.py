"""Bag and instance analytics on Spark DataFrames."""
