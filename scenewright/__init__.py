"""Spark-first analytics over landscape plans: sources, geometry, visibility, scoring, routes."""
