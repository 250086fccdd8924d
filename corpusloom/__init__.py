"""Corpus analytics and dataset preparation on Spark DataFrames."""
