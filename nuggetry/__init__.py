"""Suggestion-mining analytics on Spark DataFrames."""
