"""Metal-site analytics on Spark DataFrames."""
