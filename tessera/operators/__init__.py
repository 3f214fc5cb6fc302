"""Relational builder, record operators, write pipeline, collections and transactions."""
