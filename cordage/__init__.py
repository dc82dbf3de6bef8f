"""Dependency and text analytics on Spark."""
