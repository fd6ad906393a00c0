"""Precision-oncology analytics on Spark DataFrames."""
