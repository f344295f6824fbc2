"""Operators on document tables: pure functions from DataFrames or Columns to DataFrames or Columns."""
