"""A strictly typed analytical SQL dialect executed entirely by Spark DataFrames."""
