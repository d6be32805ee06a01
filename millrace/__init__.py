"""A dataflow-style analytics engine on Spark DataFrames."""
