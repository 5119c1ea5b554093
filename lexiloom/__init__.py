"""Knowledge-graph and lexical analytics on Spark DataFrames."""
