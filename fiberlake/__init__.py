"""fiberlake: fibre-network analytics on Spark DataFrames."""
