"""A PySpark-native analytics engine for memories, documents and conversations."""
