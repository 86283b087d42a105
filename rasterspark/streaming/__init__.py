"""Rasters that arrive as files, as Structured Streaming queries."""
