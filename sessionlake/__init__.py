"""Behavioural event analytics on Spark DataFrames."""
