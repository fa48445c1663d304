"""A PySpark-native analytics engine over a vault of notes."""
