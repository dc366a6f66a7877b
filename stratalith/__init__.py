"""Repository analytics on Spark: every analysis is a function from DataFrames to a DataFrame."""
