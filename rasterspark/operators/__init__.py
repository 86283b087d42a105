"""Relational forms of the raster operators: plans over tables of paths, points and zones."""
