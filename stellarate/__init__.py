"""Review-rating analytics on Spark DataFrames."""
