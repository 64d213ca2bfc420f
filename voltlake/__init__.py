"""Spark-native analytics over published outage schedules."""
