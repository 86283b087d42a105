"""Raster model, zones and the SQL functions over them."""
