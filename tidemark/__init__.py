"""tidemark: trading-ledger analytics on Spark DataFrames, SQL and Structured Streaming."""
