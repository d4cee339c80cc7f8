"""Message-risk analytics on Spark DataFrames."""
