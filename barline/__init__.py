"""Point-in-time market-pattern analytics on Spark DataFrames."""
