"""Log analytics on Spark DataFrames: read, filter, summarise, pair and page log rows."""
