"""Corpus retrieval, relationship-graph and ranking operators on Spark DataFrames."""
