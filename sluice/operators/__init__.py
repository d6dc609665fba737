"""Operators: functions from DataFrames (and an explicit `now`) to DataFrames."""
