"""Change feeds, live queries and remote sync."""
