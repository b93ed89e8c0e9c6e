"""Fleet reliability analytics on Spark DataFrames."""
