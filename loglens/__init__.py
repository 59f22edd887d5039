"""Usage-log analytics for a SQL query service, on Spark DataFrames."""
