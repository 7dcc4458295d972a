"""Match-graph, raster-registration and survey analytics on Spark DataFrames."""
