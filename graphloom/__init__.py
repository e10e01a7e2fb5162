"""graphloom: knowledge-graph preparation jobs expressed as Spark DataFrames."""
