"""A PySpark-native engine for a content-addressed geometric knowledge graph."""
