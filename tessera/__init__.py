"""Tessera: a Spark-first engine for typed records made of (path, attribute, value) tuples."""
