"""Text-risk analytics on Spark DataFrames."""
