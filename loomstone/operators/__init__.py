"""Metrics and transforms: functions from DataFrames to a DataFrame."""
