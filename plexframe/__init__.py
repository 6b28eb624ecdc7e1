"""A property-graph analytics library on Spark DataFrames."""
