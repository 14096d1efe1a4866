"""A PySpark-native engine for fragment-matching analytics."""
