"""Case-report signal analytics on Spark DataFrames."""
