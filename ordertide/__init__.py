"""Spark-native analytics over ordered market-event feeds."""
