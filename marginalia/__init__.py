"""Knowledge-base retrieval and link analytics on Spark DataFrames."""
