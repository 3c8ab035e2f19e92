"""Spark-native analytics over hierarchical case and security-incident records."""
