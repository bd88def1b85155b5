"""Tessera: a PySpark-native engine for retrieval analytics over text collections."""
