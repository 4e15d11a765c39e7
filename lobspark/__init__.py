"""lobspark: market-microstructure analytics as Spark DataFrame operations."""
