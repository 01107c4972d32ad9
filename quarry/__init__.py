"""Quarry: a PySpark-native engine for typed record collections."""
