"""Volatility-forecast evaluation on Spark DataFrames."""
