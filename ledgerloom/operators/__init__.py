"""Operators: functions from DataFrames to DataFrames. None of them collects rows to the driver."""
