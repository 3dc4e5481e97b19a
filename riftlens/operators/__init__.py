"""Relational operators over change records; every function maps DataFrames to DataFrames."""
