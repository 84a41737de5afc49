"""Batched, set-oriented search and evaluation over hierarchical regulatory text, on Spark DataFrames."""
