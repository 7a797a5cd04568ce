"""Telemetry analytics for AI inference and agent systems, on Spark DataFrames."""
