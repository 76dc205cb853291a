"""Append-only event logs, replay and propagation as Spark DataFrames."""
