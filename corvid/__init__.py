"""Corvid: Spark-native analytics over conversations, notes and documents."""
