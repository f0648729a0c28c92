"""Spatial queries, telemetry and experiment analytics as Spark DataFrame operators."""
