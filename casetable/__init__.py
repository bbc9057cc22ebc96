"""Preparing, judging and comparing problem corpora with Spark DataFrames."""
