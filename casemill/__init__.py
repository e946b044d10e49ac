"""Casemill: case-law analytics and corpus processing on Spark DataFrames."""
