"""A record-linkage analytics engine on Spark DataFrames."""
