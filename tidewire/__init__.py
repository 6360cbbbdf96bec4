"""A PySpark-native news-analytics engine."""
