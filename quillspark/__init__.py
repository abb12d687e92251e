"""A PySpark-native engine for bibliographic evidence collections."""
