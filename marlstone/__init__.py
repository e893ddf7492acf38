"""Marlstone: a PySpark-native analytics engine for entity and document corpora."""
