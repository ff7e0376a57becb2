"""Process-cost analytics on Spark DataFrames."""
