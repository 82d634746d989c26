"""Point-and-event observation analytics on Spark DataFrames."""
