"""tessera: job-market and document analytics on Spark DataFrames."""
