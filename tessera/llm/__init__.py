"""Training-data operators (scoring, deduplication, tokenization, mixing) on Spark DataFrames."""
