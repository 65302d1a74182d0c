"""featlab: feature-selection analytics on Spark DataFrames."""
