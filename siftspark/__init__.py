"""A PySpark-native hybrid retrieval and data-processing engine."""
