"""A PySpark-native engine for finding and reasoning about duplicate content."""
