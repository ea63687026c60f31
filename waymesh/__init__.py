"""Spark-native analytics over attributed network tables."""
