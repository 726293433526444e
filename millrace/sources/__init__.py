"""Event frames from tables, and sinks."""
