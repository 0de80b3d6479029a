"""Retrieval analytics and corpus preparation as lazily evaluated Spark DataFrames."""
