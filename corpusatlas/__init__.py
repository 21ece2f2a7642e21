"""A corpus-mapping analytics engine on Spark DataFrames."""
