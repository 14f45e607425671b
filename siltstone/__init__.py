"""Corpus preparation and run-telemetry analytics on Spark DataFrames."""
