"""Preparation and forecasting of many time series with Spark DataFrames."""
