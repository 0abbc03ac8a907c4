"""skeingraph: code-graph analytics over Spark DataFrames."""
