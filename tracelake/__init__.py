"""Spark-native analytics over agent-session traces."""
