"""Data-quality checks, profiling, cleaning and statistics as plain functions over Spark DataFrames."""
