"""Operators over DataFrames of messages, batches, segments, groups, metrics and replicas."""
