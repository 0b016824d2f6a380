"""Readers and writers of the log's own formats."""
