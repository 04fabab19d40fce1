"""Structured Streaming forms of the hourly operators."""
