"""A record-linkage engine on Spark DataFrames."""
