"""Iterative graph analytics on Spark DataFrames."""
