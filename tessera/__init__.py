"""Document-corpus analytics on Spark DataFrames."""
