"""Build, maintain and search a table of passages with Spark DataFrames."""
