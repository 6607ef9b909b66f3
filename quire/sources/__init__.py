"""Readers of the self-describing file format and of other formats, and generators."""
