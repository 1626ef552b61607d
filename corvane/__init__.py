"""Document retrieval, its evaluation and corpus building, on Spark DataFrames."""
