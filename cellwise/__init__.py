"""Regional occupancy analytics on Spark DataFrames."""
