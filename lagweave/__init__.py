"""Lagged cause-and-effect discovery over panels of time series, as Spark DataFrames."""
