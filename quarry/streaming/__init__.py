"""Structured Streaming forms of the extraction operators."""
