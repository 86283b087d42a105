"""Byte sources, the TIFF container, catalogue documents and Spark data sources."""
