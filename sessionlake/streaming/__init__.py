"""Streaming forms of the operators whose state is small."""
