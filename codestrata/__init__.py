"""Spark-native analytics over code-architecture and document graphs."""
