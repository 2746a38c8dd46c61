"""rivulet: a PySpark-native analytics engine for timestamped, nested records."""
