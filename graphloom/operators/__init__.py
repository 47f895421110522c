"""Operators on DataFrames: graph, impact, retrieval, history and telemetry."""
