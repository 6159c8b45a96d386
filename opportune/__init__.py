"""Observation-pattern analytics on Spark."""
