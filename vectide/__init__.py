"""Vector retrieval and analytics on Spark DataFrames."""
