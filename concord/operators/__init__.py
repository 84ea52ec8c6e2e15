"""Operators on DataFrames: schema, grouping, comparison, profiling, matching, audit, reports."""
