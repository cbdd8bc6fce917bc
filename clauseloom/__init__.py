"""clauseloom: document analytics on Spark DataFrames."""
