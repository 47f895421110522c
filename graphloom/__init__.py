"""graphloom: analytics over source-code graphs, change logs and agent logs, written with Spark DataFrames."""
