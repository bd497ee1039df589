"""Grounded text extraction and corpus preparation on Spark DataFrames."""
