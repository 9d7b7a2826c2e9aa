"""Operators on DataFrames of log entries."""
