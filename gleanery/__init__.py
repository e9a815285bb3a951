"""Spark-native collection, entity-resolution and monitoring engine."""
