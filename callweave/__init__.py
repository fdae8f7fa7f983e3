"""Variant call-set comparison and analytics on Spark DataFrames."""
