"""Translation of queries and patterns to DataFrame plans."""
