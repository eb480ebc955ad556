"""A message-archive analytics engine on Spark DataFrames."""
