"""Streaming forms of the page operators."""
