"""An analytics library on Spark's DataFrame, SQL and Structured Streaming interfaces."""
