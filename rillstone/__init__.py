"""Spark-native analytics over conversation and work-session history."""
