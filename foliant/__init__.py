"""Foliant: page archives, catalogue feeds and event tables as Spark DataFrames."""
