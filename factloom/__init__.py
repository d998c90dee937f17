"""Spark-native evidence analytics for coding-agent activity."""
