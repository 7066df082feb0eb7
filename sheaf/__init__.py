"""Sheaf: document analytics on Spark DataFrames."""
