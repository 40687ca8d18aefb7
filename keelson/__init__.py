"""Spark-first analytics over cryptographic inventories."""
