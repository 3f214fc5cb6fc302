"""Scalar and aggregate expression nodes and their translation to Spark columns."""
