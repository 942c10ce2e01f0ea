"""Feature-by-sample matrix analytics on Spark DataFrames."""
