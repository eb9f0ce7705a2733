"""A Spark-native engine for time-varying map data."""
