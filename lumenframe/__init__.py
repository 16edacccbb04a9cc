"""Spark-native scene-graph and region analytics."""
