"""A Spark-native analytics engine for movement tracking data."""
