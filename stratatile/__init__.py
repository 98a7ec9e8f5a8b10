"""Vector-tile layers and tabular analytics on Spark DataFrames."""
