"""Structured Streaming forms of the operators, and the log as a table that streams append to."""
