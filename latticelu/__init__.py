"""A PySpark-native engine for sparse linear systems."""
