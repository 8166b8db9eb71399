"""Knowledge-graph retrieval and analytics expressed with Spark DataFrames."""
