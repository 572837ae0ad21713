"""A Spark-native engine for raster and symbol-stream analytics."""
