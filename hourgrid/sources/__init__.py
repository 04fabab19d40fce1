"""Readers, payload parsers and sinks."""
