"""A Spark-native engine for structural-site analytics."""
