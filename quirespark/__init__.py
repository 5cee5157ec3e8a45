"""quirespark: document analytics on Spark DataFrames."""
