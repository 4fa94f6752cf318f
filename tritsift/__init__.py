"""tritsift: sparse-vector retrieval analytics as Spark DataFrames."""
