"""Incremental forms of batch jobs on Structured Streaming."""
