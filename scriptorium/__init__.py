"""Document analytics and retrieval over large text collections, on Spark DataFrames."""
