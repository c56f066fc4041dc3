"""Fault-knowledge analytics on Spark."""
