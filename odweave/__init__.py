"""Origin-destination flow analytics on Spark DataFrames."""
