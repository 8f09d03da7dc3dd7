"""Double-entry accounting analytics on Spark DataFrames."""
