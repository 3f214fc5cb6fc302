"""Sources, sinks and storage drivers."""
