"""Sondage: data profiling, anonymisation, cleaning and clustering on Spark DataFrames."""
