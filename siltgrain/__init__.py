"""A text retrieval and analytics engine on Spark DataFrames."""
