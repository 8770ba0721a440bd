"""lakekit: run, check and report on a lakehouse with plain Spark DataFrames."""
