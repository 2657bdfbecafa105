"""Station-observation analytics on Spark DataFrames."""
