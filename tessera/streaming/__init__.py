"""Structured Streaming forms of the dialect's dataflow."""
