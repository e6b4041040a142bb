"""A PySpark-native analytics engine for event-derived features."""
