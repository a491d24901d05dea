"""Pattern matching and graph analytics over property graphs, on Spark DataFrames."""
