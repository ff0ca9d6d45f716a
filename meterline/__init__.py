"""Spark-first analytics over the telemetry of coding agents."""
