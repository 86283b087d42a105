"""Column expressions of the tile grid: pure Spark SQL, no Python on the data path."""
