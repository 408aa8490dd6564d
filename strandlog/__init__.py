"""A PySpark-native engine for append-only, hash-chained operation logs."""
