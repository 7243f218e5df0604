"""Relational operators: plain functions from DataFrames to lazy DataFrames."""
