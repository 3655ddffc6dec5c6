"""Durable-task analytics and data preparation on Spark DataFrames."""
